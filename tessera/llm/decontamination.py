"""Operator 9: benchmark decontamination with a generalised suffix automaton."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tessera.plans.session import discard, materialize

WINDOW = 10
#: Words of items in one automaton (about 40 MB in a Python worker); more items go in further passes.
MAX_AUTOMATON_WORDS = 100_000
#: A span that is removed has at least as many words or is a whole shorter item; a document over this covered share is dropped.
MIN_SPAN_WORDS = WINDOW
MAX_COVERAGE = 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # after A-Z became a-z
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Bytes to bytes: A-Z to a-z, other ASCII but letters and digits to a blank, the bytes of other characters as they are.
_BYTES = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Automaton:
    """Generalised suffix automaton of token lists, with the items of its windows.

    One dict holds all transitions, keyed by state * n_words + word. `window_items` maps a state that
    spells a full window to its items; `short_items` does so for items shorter than a window.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = []
        for key, words in items:
            if words:
                coded.append((key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        self.width = len(self.vocabulary) + 1
        self.length, self.link = [0], [-1]
        self.next: dict[int, int] = {}
        self.out: list[list[int]] = [[]]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.window_items: dict[int, set[str]] = defaultdict(set)
        self.short_items: dict[int, tuple[int, set[str]]] = {}
        self.shortest = window
        for key, ids in coded:
            size = min(window, len(ids))
            self.shortest = min(self.shortest, size)
            for i in range(len(ids) - size + 1):
                state = 0
                for w in ids[i : i + size]:
                    state = self.next[state * self.width + w]
                if size == window:
                    self.window_items[state].add(key)
                else:
                    self.short_items.setdefault(state, (size, set()))[1].add(key)
        pairs = {a * self.width + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.out = []

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        nxt, width = self.next, self.width
        known = nxt.get(last * width + word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and p * width + word not in nxt:
            nxt[p * width + word] = state
            self.out[p].append(word)
            p = self.link[p]
        if p >= 0:
            q = nxt[p * width + word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the strings that end at p plus the word."""
        nxt, width = self.next, self.width
        copy = self._new(self.length[p] + 1, self.link[q])
        self.out[copy] = list(self.out[q])
        for w in self.out[q]:
            nxt[copy * width + w] = nxt[q * width + w]
        self.link[q] = copy
        while p >= 0 and nxt.get(p * width + word) == q:
            nxt[p * width + word] = copy
            p = self.link[p]
        return copy

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges [start, end) over a run of known words, and the items that hit."""
        nxt, width, link, length, window = self.next, self.width, self.link, self.length, self.window
        hits, items, state, size = [], set(), 0, 0
        for i, w in enumerate(ids):
            to = nxt.get(state * width + w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt.get(state * width + w)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                hits.append((i - size + 1, i + 1))
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items |= self.window_items.get(at, set())
            if self.short_items:
                at, most = state, size
                while at > 0:
                    found = self.short_items.get(at)
                    if found and found[0] <= most:
                        hits.append((i - found[0] + 1, i + 1))
                        items |= found[1]
                    at = link[at]
                    most = length[at]
        return hits, items


def _runs(ids: np.ndarray, automaton: Automaton) -> list[tuple[int, int]]:
    """Ranges of words that can hold a window: every neighbouring pair of words occurs in an item."""
    if automaton.shortest == 1:
        good = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        return list(zip(good[::2].tolist(), good[1::2].tolist(), strict=True))
    if len(ids) < 2 or not len(automaton.pairs):
        return []
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    code = np.where(both, ids[:-1] * automaton.width + ids[1:], -1)
    at = np.minimum(np.searchsorted(automaton.pairs, code), len(automaton.pairs) - 1)
    good = (both & (automaton.pairs[at] == code)).view(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], good, [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= automaton.shortest - 1
    return list(zip(starts[long].tolist(), (ends[long] + 1).tolist(), strict=True))


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: str, spans: list[tuple[int, int]], ranges: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last : spans[a][0]])
        last = spans[b - 1][1]
    return "".join([*out, text[last:]])


RANGES = "array<struct<start:long,end:long>>"
FOUND = pa.struct(
    [("n_words", pa.int64())]
    + [(k, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for k in ("hits", "short")]
    + [("items", pa.list_(pa.string()))]
)


def _scan_batches(shared, text_at: tuple[str, ...], first: bool):
    """mapInArrow body: adds what one automaton finds in a row's text to the column `found`.

    `hits` are the merged ranges of full windows, `short` those of whole items shorter than a window.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        get, window = automaton.vocabulary.get, automaton.window
        for batch in batches:
            texts = batch.column(text_at[0])
            for name in text_at[1:]:
                texts = pc.struct_field(texts, [name])
            before = [None] * batch.num_rows if first else batch.column("found").to_pylist()
            found = []
            for text, old in zip(texts, before, strict=True):
                words = words_of(text.as_py())
                hits, items = [], set()
                if words:
                    ids = np.array([get(w, -1) for w in words], dtype=np.int64)
                    for a, b in _runs(ids, automaton):
                        ranges, keys = automaton.scan(ids[a:b].tolist())
                        hits += [(a + x, a + y) for x, y in ranges]
                        items |= keys
                long, short = [h for h in hits if h[1] - h[0] >= window], [h for h in hits if h[1] - h[0] < window]
                if old:
                    long += [(h["start"], h["end"]) for h in old["hits"]]
                    short += [(h["start"], h["end"]) for h in old["short"]]
                    items |= set(old["items"])
                sides = {k: [{"start": a, "end": b} for a, b in _merge(v)] for k, v in (("hits", long), ("short", short))}
                found.append({"n_words": len(words), **sides, "items": sorted(items)})
            kept = [k for k in batch.schema.names if k != "found"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(found, FOUND)], names=[*kept, "found"])

    return scan


#: Passes that run in one task after another over a batch, in one Python worker; then the rows are written.
PASSES_A_STAGE = 4


def _chained(steps: list):
    """One mapInArrow body out of several: a batch goes through all of them in one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def _all_hits(rows: DataFrame, found: Iterable[Automaton], window: int, text_at: tuple[str, ...], last, last_schema) -> DataFrame:
    """What `last` makes of `rows` with a column `found`: every automaton reads the same text of each row, and its hits join those before.

    A map without a shuffle or a key, so rows with equal or null ids stay apart. With many automata the rows are written in
    between; a written table goes when the next one is there.
    """
    sc = rows.sparkSession.sparkContext
    schema = StructType([*rows.schema.fields, StructField("found", _parse_datatype_string(f"n_words long, hits {RANGES}, short {RANGES}, items array<string>"))])
    n, held, steps, written = 0, [], [], None
    for automaton in found:
        if n and n % PASSES_A_STAGE == 0:
            rows, before = materialize(rows.mapInArrow(_chained(steps), schema), "hits"), written
            if before is not None:
                discard(before)
            written, steps = rows, []
            while held:  # what these automata found is written
                held.pop().destroy()
        held.append(sc.broadcast(automaton))
        steps.append(_scan_batches(held[-1], text_at, not n))
        n += 1
    if not n:
        steps.append(_scan_batches(sc.broadcast(Automaton([], window)), text_at, True))
    return rows.mapInArrow(_chained([*steps, last]), last_schema)


def _ranges(found: dict, min_span: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """All hit ranges of a row, and those to cut: of `min_span` words or more, or a whole short item."""
    short = [(h["start"], h["end"]) for h in found["short"]]
    hits = _merge([(h["start"], h["end"]) for h in found["hits"]] + short)
    return hits, _merge([(a, b) for a, b in hits if b - a >= min_span] + short)


def _without(text: str, ranges: list[tuple[int, int]]) -> str:
    return _cut(text, [m.span() for m in _WORD.finditer(text.translate(_UPPER))], ranges)


def automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_words: int) -> Iterator[Automaton]:
    """Automata over all items, each of at most `max_words` words (an item longer than that is cut with overlap).

    Items are numbered in blocks by a running sum of word counts, and one block at a time comes to the
    driver, so what is held and broadcast has a fixed bound however large the benchmark is.
    """
    n_words = F.size(F.split(F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("t"), n_words.alias("n"))
    items = items.filter("item is not null and t is not null")
    total = items.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // max(1, max_words // 2)))
    for s in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(shards)) == s)
        coded: list[tuple[str, list[bytes]]] = []
        size = 0
        for row in part.select("item", "t").toLocalIterator():
            words = words_of(row["t"])
            step = max_words - window
            pieces = [words[i : i + max_words] for i in range(0, max(1, len(words) - window + 1), step)]
            for piece in pieces:
                if coded and size + len(piece) > max_words:
                    yield Automaton(coded, window)
                    coded, size = [], 0
                coded.append((row["item"], piece))
                size += len(piece)
        if coded:
            yield Automaton(coded, window)


HITS = "n_words long, hits array<struct<start:long,end:long>>, items array<string>, clean string"


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_span: int = MIN_SPAN_WORDS,
    max_words: int = MAX_AUTOMATON_WORDS,
    with_text: bool = False,
) -> DataFrame:
    """Benchmark passages in each document: (id, n_words, hits, items, clean), one row per input row.

    Words are streamed through a suffix automaton of the items; wherever the longest match reaches the
    window (or all of a shorter item), the matched words are hit. `hits` are merged word ranges
    [start, end), `items` the sorted ids of the items with an occurring window; with `with_text`,
    `clean` is the text without the hit ranges of `min_span` words or more and without whole items
    shorter than the window (null: nothing hit).
    A filter on word pairs, which loses no match, keeps most text out of the automaton.

    The scan is a map over documents without a shuffle. A benchmark over half of `max_words` words is
    scanned in blocks, each over the whole text of every row; ids are not used and may repeat or be null.

    Cases: null texts have no words; items without words match nothing; null items are left out;
    repeated items count once per id; an empty benchmark hits nothing; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, clean = batch.column("found").to_pylist(), []
            ranges = [_ranges(f, min_span) for f in found]
            for text, (hits, cut) in zip(batch.column("text"), ranges, strict=True):
                clean.append(_without(text.as_py(), cut) if with_text and hits else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([f["n_words"] for f in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in hits] for hits, _ in ranges], FOUND.field("hits").type),
                    pa.array([f["items"] for f in found], pa.list_(pa.string())),
                    pa.array(clean, pa.string()),
                ],
                names=["id", "n_words", "hits", "items", "clean"],
            )

    kind = base.schema["id"].dataType.simpleString()
    found = automata(benchmark, item_col, item_text_col, window, max_words)
    return _all_hits(base, found, window, ("text",), finish, f"id {kind}, {HITS}").withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, **kwargs) -> DataFrame:
    """The documents with benchmark passages cut out of `text`; a document covered beyond `max_coverage` goes.

    The columns are those of `docs`; untouched documents keep their text to the letter. A row's text
    is cleaned where it is read, so nothing is joined back and repeated ids do no harm. Coverage and
    cuts are judged once, by the hits of all blocks of the benchmark on the text as it came.
    Cases as in `find_contamination`.
    """
    window, min_span = kwargs.get("window", WINDOW), kwargs.get("min_span", MIN_SPAN_WORDS)
    found = automata(benchmark, "item_id", "text", window, kwargs.get("max_words", MAX_AUTOMATON_WORDS))
    # The caller's columns travel in a struct, so their names do not meet `found`.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return _all_hits(rows, found, window, ("row", "text"), _clean_batches(min_span, max_coverage), docs.schema)


def _clean_batches(min_span: int, max_coverage: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            out = pa.RecordBatch.from_arrays(row.flatten(), schema=pa.schema(list(row.type)))
            at = out.schema.get_field_index("text")
            texts, keep = out.column(at).to_pylist(), []
            for i, found in enumerate(batch.column("found").to_pylist()):
                hits, cut = _ranges(found, min_span)
                keep.append(sum(b - a for a, b in hits) <= max_coverage * found["n_words"])
                if cut:
                    texts[i] = _without(texts[i], cut)
            out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    return clean


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents, with the digest columns of the contract."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select item, w, least(10, len(w)) as k from b where len(w) > 0),
x as (select distinct item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') as g
      from (select item, w, k, unnest(range(1, len(w) - k + 2)) as p from i)),
sizes as (select distinct k from x),
g as (select doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') as g
      from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, sizes)),
h as (select g.doc_id, g.k, g.p, x.item from g join x on g.k = x.k and g.g = x.g),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
       sha256(coalesce(t.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""
