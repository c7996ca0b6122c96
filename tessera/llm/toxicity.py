"""Operator 8: toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import materialize

#: Expected number of labelled documents that the model is fitted on, and the most that come to the driver.
MAX_TRAIN_DOCS = 20_000
#: Most terms of all training documents together that come to the driver (4 bytes each); beyond that whole documents
#: stay out, by a hash of their id in so many slots.
MAX_TRAIN_TERMS = 40_000_000
SLOTS = 1024
BUCKETS = 1 << 18
FACTORS = 8
EPOCHS = 8
BATCH = 64
RATE, FACTOR_RATE = 0.5, 0.1
L2 = 1e-3
#: A term takes part from this many training documents on; every fifth document calibrates the scores.
MIN_DOCS = 5
CALIBRATE = 5
PREFIX = 5

_WORD = re.compile(r"[^\W\d_]+")


def term_ids(text: str | None, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct buckets of the words of a text and, for longer words, of their first letters."""
    if len(cache) > 200_000:
        cache.clear()
    ids: set[int] = set()
    for w in set(_WORD.findall(text or "")):
        found = cache.get(w)
        if found is None:
            low = w.lower()
            terms = [low, f"{low[:PREFIX]}*"] if len(low) > PREFIX else [low]
            found = cache[w] = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for t in terms)
        ids.update(found)
    return np.array(sorted(ids), dtype=np.int32)


@dataclass
class FactorizationMachine:
    """Bias, linear weights and factor vectors by term bucket; a text is the set of its terms.

    A present term has the value of its inverse document frequency, scaled so that a text has length 1.
    `slope` and `shift` turn the machine's output into a calibrated log-odds.
    """

    bias: float
    linear: np.ndarray  # (BUCKETS,)
    factors: np.ndarray  # (BUCKETS, FACTORS)
    idf: np.ndarray  # (BUCKETS,), 0 for terms that take no part
    slope: float = 1.0
    shift: float = 0.0
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, ids in enumerate(rows):
            ids = ids[self.idf[ids] > 0]
            if len(ids):
                x = self.idf[ids] / np.linalg.norm(self.idf[ids])
                own = self.factors[ids] * x[:, None]
                out[i] += self.linear[ids] @ x + 0.5 * (own.sum(axis=0) ** 2 - (own**2).sum(axis=0)).sum()
        return out

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(rows) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> FactorizationMachine:
    """Logistic loss, minibatches, adaptive step sizes; the same for the same rows in any order."""
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i].tobytes()), len(rows[i]), int(labels[i])))
    rows, labels = [rows[i] for i in order], labels[order].astype(np.float64)
    rng = np.random.default_rng(seed)
    rate = min(max(labels.mean() if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    df = np.bincount(np.concatenate(rows), minlength=BUCKETS) if rows else np.zeros(BUCKETS)
    fm = FactorizationMachine(
        float(np.log(rate / (1 - rate))),
        np.zeros(BUCKETS, dtype=np.float32),
        rng.normal(0, 0.01, (BUCKETS, FACTORS)).astype(np.float32),
        np.where(df >= MIN_DOCS, np.log((len(rows) + 1) / np.maximum(df, 1)), 0).astype(np.float32),
    )
    rows = [r[fm.idf[r] > 0] for r in rows]
    usable = np.array([i for i in range(len(rows)) if len(rows[i]) and i % CALIBRATE], dtype=np.int64)
    if len(np.unique(labels[usable])) < 2:
        return fm
    g_linear = np.full(BUCKETS, 0.1, dtype=np.float32)
    g_factors = np.full((BUCKETS, FACTORS), 0.1, dtype=np.float32)
    g_bias = 1.0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(usable), max(1, len(usable) // BATCH)):
            batch = [rows[i] for i in part]
            lengths = np.array([len(r) for r in batch])
            ids = np.concatenate(batch)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            x = fm.idf[ids]
            x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, starts)), lengths)
            own = fm.factors[ids] * x[:, None]
            total = np.add.reduceat(own, starts, axis=0)
            squares = np.add.reduceat(own**2, starts, axis=0)
            logit = fm.bias + np.add.reduceat(fm.linear[ids] * x, starts) + 0.5 * (total**2 - squares).sum(axis=1)
            error = _sigmoid(logit) - labels[part]
            g = np.repeat(error, lengths).astype(np.float32) * x
            by = np.argsort(ids, kind="stable")
            unique, first = np.unique(ids[by], return_index=True)
            d_linear = np.add.reduceat(g[by], first) + L2 * fm.linear[unique]
            slope = g[:, None] * (np.repeat(total, lengths, axis=0) - own)
            d_factors = np.add.reduceat(slope[by], first, axis=0) + L2 * fm.factors[unique]
            g_linear[unique] += d_linear**2
            g_factors[unique] += d_factors**2
            fm.linear[unique] -= RATE * d_linear / np.sqrt(g_linear[unique])
            fm.factors[unique] -= FACTOR_RATE * d_factors / np.sqrt(g_factors[unique])
            d_bias = float(error.sum())
            g_bias += d_bias**2
            fm.bias -= RATE * d_bias / g_bias**0.5
    fm.slope, fm.shift = _calibration(fm.raw(rows[::CALIBRATE]), labels[::CALIBRATE])
    return fm


def _calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over z, with smoothed targets, by Newton's method."""
    positive, negative = y.sum(), len(y) - y.sum()
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    both = np.stack([z, np.ones_like(z)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(both @ w)
        step = np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + 1e-6 * np.eye(2), both.T @ (p - target))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_TRAIN_DOCS, max_terms: int = MAX_TRAIN_TERMS) -> FactorizationMachine:
    """Fit on about `max_docs` labelled documents, taken by a hash of their id.

    Of several labels of an id the largest holds; null labels and texts are left out. Each of these
    documents is used with all of its terms. What comes to the driver is bounded: about `max_docs`
    rows of at most `max_terms` term buckets together; if there are more, fewer documents are taken.
    Without any label every text scores 0.001 and is predicted 0; with labels of one class only, all score that
    class's share, kept between 0.001 and 0.999.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n = known.count()
    if n > max_docs:
        known = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    known = known.limit(2 * max_docs)  # the hash makes it about max_docs; this is the proof for the broadcast
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            ids = [term_ids(t.as_py(), cache).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("y"), pa.array(ids, pa.list_(pa.int32()))], names=["slot", "y", "ids"])

    slot = F.pmod(F.xxhash64(F.lit("slot"), "id"), F.lit(SLOTS)).cast("int").alias("slot")
    rows = base.join(F.broadcast(known), "id").select(slot, F.col("y").cast("int").alias("y"), "text")
    rows = materialize(rows.mapInArrow(terms, "slot int, y int, ids array<int>"), "terms")
    sizes = np.zeros(SLOTS, dtype=np.int64)
    for r in rows.groupBy("slot").agg(F.sum(F.size("ids")).alias("n")).collect():
        sizes[r["slot"]] = r["n"]
    table = rows.filter(F.col("slot") < int((np.cumsum(sizes) <= max_terms).sum())).select("y", "ids").toArrow()
    lists = table["ids"].combine_chunks()
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    return fit([values[a:b] for a, b in zip(at, at[1:], strict=False)], table["y"].to_numpy())


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row, a map over whole texts.

    Cases: null and empty texts score the model's bias; repeated rows repeat; an empty table gives an
    empty result; other columns are not read. The broadcast model has a fixed size (10 MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm: FactorizationMachine = shared.value
        for batch in batches:
            p = fm.probabilities([term_ids(t.as_py(), fm.cache) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                names=["id", "score", "predicted"],
            )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(scan, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def _held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(~_held_out()))
    return score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", "predicted")
