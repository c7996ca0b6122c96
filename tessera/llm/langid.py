"""Operator 1: language identification with Viterbi over per-word scores."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expected number of labelled documents that the model is fitted on.
MAX_TRAIN_DOCS = 20_000
BUCKETS = 1 << 15
#: Log-odds that a change of language must gain.
SWITCH_PENALTY = 8.0
#: A language needs this share of a script's training letters to be a candidate for words in it.
MIN_SCRIPT_SHARE = 0.001
UND = "und"

_PLAIN, _ALNUM = re.compile(r"[A-Za-z]+"), re.compile(r"[^\W\d_]+")
#: A letter, then letters and the marks on them; needed where a text has marks, or numerals such as ½ that are no digits.
_LETTERS, _RARE = regex.compile(r"\p{L}[\p{L}\p{M}]*"), regex.compile(r"[\p{M}\p{Nl}\p{No}]")
#: First and last code point of the main letter ranges of scripts.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
]
SCRIPTS = sorted({s for _, _, s in SCRIPT_RANGES}) + ["Other"]


def _word_pattern(text: str):
    """The fastest pattern that finds the words of this text: runs of letters (category L) with their marks."""
    return _PLAIN if text.isascii() else _LETTERS if _RARE.search(text) else _ALNUM


def script_of(word: str) -> int:
    """Index in SCRIPTS of the word's first letter."""
    point = ord(word[0])
    for first, last, name in SCRIPT_RANGES:
        if first <= point <= last:
            return SCRIPTS.index(name)
    return len(SCRIPTS) - 1


#: A run of letters longer than that (as in scripts without blanks) is scored in units; they overlap, so that no piece is lost.
MAX_UNIT, OVERLAP = 40, 3


def _unit_spans(run: str) -> list[tuple[int, int, int]]:
    """(start, end, end of what is scored) of the units of a run: cut where the script changes, then at a fixed length."""
    codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    script = np.full(len(codes), len(SCRIPTS) - 1)
    for first, last, name in reversed(SCRIPT_RANGES):
        script[(codes >= first) & (codes <= last)] = SCRIPTS.index(name)
    edges = [0, *(np.flatnonzero(np.diff(script)) + 1).tolist(), len(run)]
    return [(i, min(i + MAX_UNIT, b), min(i + MAX_UNIT + OVERLAP, b)) for a, b in zip(edges, edges[1:], strict=False) for i in range(a, b, MAX_UNIT)]


def units(text: str) -> tuple[list[str], list[tuple[int, int]] | None]:
    """The words of a text, long runs in units; and all their spans if there is such a run."""
    pattern = _word_pattern(text)
    words = pattern.findall(text)
    if not words or max(map(len, words)) <= MAX_UNIT:
        return words, None
    out, spans = [], []
    for m in pattern.finditer(text):
        run, at = m[0], m.start()
        cuts = [(0, len(run), len(run))] if len(run) <= MAX_UNIT else _unit_spans(run)
        out += [run[a:c] for a, _, c in cuts]
        spans += [(at + a, at + b) for a, b, _ in cuts]
    return out, spans


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words' places): hash buckets of each word and of its 1- to 4-letter pieces, ends marked."""
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in marked])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # letters up to the word's end
    place = (np.arange(len(codes)) - np.repeat(starts, lengths)).astype(np.uint64)
    whole = np.add.reduceat(codes * np.power(np.uint64(0x9E3779B1), place), starts)
    hashes, owners = [whole * np.uint64(7)], [np.arange(len(words))]
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, 5):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        ok = left[: len(h)] >= n
        hashes.append(h[ok])
        owners.append(word[: len(h)][ok])
    mixed = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(owners)


#: Words whose scores a worker keeps; beyond that it starts anew.
CACHE_WORDS = 100_000


@dataclass
class Model:
    """Log-probabilities of feature buckets per language, relative to their mean, and each script's languages."""

    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs)
    allowed: np.ndarray  # (SCRIPTS, langs)
    cache: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """(words, langs): sums over a word's pieces; languages that don't use its script fall far behind."""
        buckets, owner = features(words)
        s = np.stack([np.bincount(owner, weights=self.weights[buckets, k], minlength=len(words)) for k in range(len(self.langs))], axis=1) / 4
        ok = self.allowed[[script_of(w) for w in words]]
        ok |= ~ok.any(axis=1, keepdims=True)
        return np.where(ok, s, s.min(axis=1, keepdims=True) - 20).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """The same through a cache of bounded size."""
        cache, unique = self.cache, set(words)
        missing = [w for w in unique if w not in cache]
        if self.table is None or len(cache) + len(missing) > CACHE_WORDS:
            cache.clear()
            missing = list(unique)
        if self.table is None or len(self.table) < len(cache) + len(missing):
            grown = np.zeros((max(CACHE_WORDS, len(missing)), len(self.langs)), dtype=np.float32)
            if cache:
                grown[: len(cache)] = self.table[: len(cache)]
            self.table = grown
        for at in range(0, len(missing), 10_000):
            part = missing[at : at + 10_000]
            self.table[len(cache) : len(cache) + len(part)] = self.score(part)
            cache.update(zip(part, range(len(cache), len(cache) + len(part)), strict=True))
        return self.table[np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))]


def constant_is_best(scores: np.ndarray, penalty: float) -> int:
    """The language that surely labels the whole text, or -1.

    If no stretch gains more than half of the penalty from any one other language, no path with changes
    is better: k stretches in other languages cost k - 1 changes at least, and one change if k is 1; for
    k of 2 or more, k - 1 is half of k at least.
    """
    top = int(scores.sum(axis=0, dtype=np.float64).argmax())
    gain = np.cumsum(scores - scores[:, top : top + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low = np.concatenate((np.zeros((1, scores.shape[1])), low[:-1]))
    return top if (gain - low).max() <= penalty / 2 else -1


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """Best language path per document; a step costs `penalty` if it changes language. Runs over documents at once."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    paths: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(scores)
    at = 0
    while at < len(order) and len(scores[order[at]]):
        steps = len(scores[order[at]])
        group = [i for i in order[at : at + max(1, 1_000_000 // steps)] if len(scores[i])]
        at += max(1, 1_000_000 // steps)
        lengths = np.array([len(scores[i]) for i in group])
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than t
        n_langs = scores[group[0]].shape[1]
        padded = np.zeros((steps, len(group), n_langs), dtype=np.float32)
        for j, i in enumerate(group):
            padded[: len(scores[i]), j] = scores[i]
        best = padded[0].copy()
        top = np.zeros((steps, len(group)), dtype=np.int8)
        moved = np.zeros((steps, len(group), n_langs), dtype=bool)
        for t in range(1, steps):
            k = live[t]
            now = best[:k]
            most = now.max(axis=1)
            top[t, :k] = now.argmax(axis=1)
            change = most[:, None] - penalty
            moved[t, :k] = change > now
            best[:k] = np.maximum(now, change) + padded[t, :k]
        state = best.argmax(axis=1).astype(np.int8)
        path = np.zeros((steps, len(group)), dtype=np.int8)
        each = np.arange(len(group))
        for t in range(steps - 1, -1, -1):
            k = live[t]
            path[t, :k] = state[:k]
            if t:
                back = moved[t, each[:k], state[:k]]
                state[:k] = np.where(back, top[t, :k], state[:k])
        for j, i in enumerate(group):
            paths[i] = path[: lengths[j], j]
    return paths


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit the model on about `max_docs` labelled documents, taken by a hash of their id.

    Feature counts per language are summed by Spark; what comes to the driver is at most
    BUCKETS x languages sums, whatever the corpus.
    """
    base = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = base.count()
    if n > max_docs:
        base = base.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            sums: dict[str, np.ndarray] = {}
            letters: dict[tuple[str, int], int] = Counter()
            for lang, found in words.items():
                sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                each, times = list(found), np.array(list(found.values()))
                for at in range(0, len(each), 20_000):
                    buckets, owner = features(each[at : at + 20_000])
                    sums[lang] += np.bincount(buckets, weights=times[at + owner], minlength=BUCKETS).astype(np.int64)
                for w, n in found.items():
                    letters[lang, script_of(w)] += n * len(w)
            words.clear()
            rows = [(lang, int(b), int(v[b])) for lang, v in sums.items() for b in np.flatnonzero(v)]
            rows += [(lang, -1 - s, v) for (lang, s), v in letters.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())],
                names=["lang", "bucket", "n"],
            )

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                words[lang.as_py()].update(units(text.as_py())[0])
            if sum(map(len, words.values())) > 100_000:
                yield flush()
        yield flush()

    sums = base.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, bucket int, n long")
    table = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    code = np.array([langs.index(x) for x in table["lang"].to_pylist()], dtype=np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy().astype(np.float64)
    counts = np.full((BUCKETS, max(1, len(langs))), 0.5)
    letters = np.zeros((len(SCRIPTS), max(1, len(langs))))
    own = bucket >= 0
    counts[bucket[own], code[own]] += n[own]
    letters[-1 - bucket[~own], code[~own]] = n[~own]
    logs = np.log(counts / counts.sum(axis=0))
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(langs, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), share >= MIN_SCRIPT_SHARE)


SPANS = "array<struct<start:long,end:long,lang:string>>"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, with_spans: bool = True) -> DataFrame:
    """(id, lang_pred, score, spans): each text's main language and its spans by language.

    A word's script narrows its candidates; its pieces score them; the best path over the words, with
    a price on changes, labels the text. `lang_pred` is the language with the most letters on the
    path (ties: first in code-point order), `score` its share of the letters, `spans` the stretches
    of one language as [start, end) in code points.

    Cases: a null or empty text, or one without letters (Unicode category L; numerals such as ½, ② or Ⅻ
    are none), is `und` with score 0 and no spans; so is every text if nothing was learned; repeated rows repeat; an empty table gives an empty result;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            langs, values, spans = _identify_batch(m, batch.column("text"), penalty, with_spans)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(langs, pa.string()),
                    pa.array(values, pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))),
                ],
                names=["id", "lang_pred", "score", "spans"],
            )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(scan, f"id {kind}, lang_pred string, score double, spans {SPANS}").withColumnRenamed("id", id_col)


def _identify_batch(m: Model, texts: pa.Array, penalty: float, with_spans: bool) -> tuple[list, list, list]:
    """Languages, scores and spans of a batch; texts that may change language go through Viterbi together."""
    n = len(texts)
    langs, values, spans, pending = [UND] * n, [0.0] * n, [[] for _ in range(n)], []

    def decode() -> None:
        for (i, _, sizes), path in zip(pending, viterbi([s for _, s, _ in pending], penalty), strict=True):
            letters = np.bincount(path, weights=sizes, minlength=len(m.langs))
            top = int(letters.argmax())
            langs[i], values[i] = m.langs[top], float(letters[top] / letters.sum())
            if with_spans:
                spans[i] = _spans(texts[i].as_py(), path, m.langs)
        pending.clear()

    waiting = 0
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        words, cuts = units(text) if m.langs else ([], None)
        if not words:
            continue
        s = m.scores(words)
        top = constant_is_best(s, penalty)
        if top < 0:
            sizes = (b - a for a, b in cuts) if cuts else map(len, words)
            pending.append((i, s, np.fromiter(sizes, dtype=np.int32, count=len(words))))
            waiting += len(words)
            if waiting > 250_000:  # bounds what is held
                decode()
                waiting = 0
            continue
        langs[i], values[i] = m.langs[top], 1.0
        if with_spans:
            first, last = _ends(text)
            spans[i] = [{"start": first, "end": last, "lang": m.langs[top]}]
    decode()
    return langs, values, spans


def keep_identified(docs: DataFrame, model: Model, min_score: float, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a learned language with at least that score; a map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _identify_batch(shared.value, batch.column(column), penalty, with_spans=False)
            keep = [lang != UND and value >= min_score for lang, value in zip(got[0], got[1], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def _ends(text: str) -> tuple[int, int]:
    """Start of the first word and end of the last; marks after a letter belong to its word."""
    pattern = _word_pattern(text)
    start, at = pattern.search(text).start(), len(text)
    while not pattern.match(text, at - 1):
        at -= 1
    if pattern is _LETTERS:  # the last letter's word runs on over its marks
        at = pattern.match(text, at - 1).end()
    return start, at


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    at = units(text)[1] or [m.span() for m in _word_pattern(text).finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1], "lang": langs[path[a]]} for a, b in zip(edges, edges[1:], strict=False)]


def _held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~_held_out()))
    # The predictor gets id and text only; the id goes through unread.
    found = identify(docs, model)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "spans")
