"""Operator 12: alignment of two tokenizers' tokens over the bytes of a text, in Arrow, with corpus-wide link counts."""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.sentencepieces import SPACE, encoder, steps
from tessera.plans.session import materialize

#: Text whose tokens are in Arrow tables at a time, and text whose pairs share one dictionary.
STEP_BYTES = 2_000_000
BLOCK_BYTES = 16_000_000


def byte_alphabet() -> dict[str, int]:
    """Byte of each letter of byte-level entries: printable Latin letters stand for themselves, the other bytes for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level BPE from a tokenizers file: ids of texts, special strings as plain text, and the bytes of each id.

    Where ids rank the merges, the rank merger of tiktoken gives the same ids several times as fast; else the library of the
    file does it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["id"] for t in spec["added_tokens"]}
        vocab = {i: t for t, i in spec["model"]["vocab"].items() if i not in special}
        self.bytes = [bytes(letters[c] for c in vocab[i]) if i in vocab else b"" for i in range(max([*vocab, *special]) + 1)]
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in merges]
        splits = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits["add_prefix_space"]
        singles = {i for i, b in enumerate(self.bytes) if len(b) == 1}
        if plain and made == sorted(made) and singles | set(made) == set(vocab) and max(singles) < min(made):
            import public_tokenizers
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if i in vocab}
            coder = tiktoken.Encoding("byte-pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [coder.encode_ordinary(t) for t in texts]
            self.apart = True  # no token goes on over a space after another character
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
            self.apart = False


class Pieces:
    """A SentencePiece model: ids of texts that begin with the space it adds, and the bytes of each id."""

    def __init__(self, path: str):
        self.coder = encoder(path)
        whole = self.coder.whole
        byte = lambda i, p: bytes([int(p[3:5], 16)]) if whole.is_byte(i) else p.replace(SPACE, " ").encode()
        self.bytes = [byte(i, whole.id_to_piece(i)) for i in range(whole.get_piece_size())]
        self.apart = self.coder.apart is not None and self.coder.char_map.starts is None and not self.coder.extra and self.coder.own is None

    def encode(self, texts: list[str]) -> list:
        if self.apart:
            return self.coder.merger.encode([t.replace(" ", SPACE) for t in texts], num_threads=1)
        return [ids for ids, _ in self.coder.ids([self.coder.normalize(t[1:])[0] for t in texts])]


@functools.lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> tuple[BytePairs, Pieces]:
    return BytePairs(path_a), Pieces(path_b)


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]), pa.int32())


def _lists(ids: list) -> pa.ListArray:
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32)
    return pa.ListArray.from_arrays(_offsets(list(map(len, ids))), pa.array(flat, pa.int32()))


def _faithful(tokens: pa.ListArray, pieces: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of each list's tokens are those of the text."""
    said = pc.take(pieces, pc.list_flatten(tokens))
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(said).to_numpy(zero_copy_only=False), dtype=np.int64)])
    starts = sizes[np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))])]
    data = b"".join(said.to_pylist()) if said.offset else (said.buffers()[2].to_pybytes() if len(said) else b"")
    return np.array([data[a:b] == t for a, b, t in zip(starts[:-1], starts[1:], texts, strict=True)], bool)


def ends(tokens: pa.ListArray, widths: pa.Array, sizes: pa.Array, name: str) -> pa.Table:
    """(key, name, name_doc) of each token: its list, and the byte where it ends in all texts laid end to end.

    The end in its own text is a cumulative sum segmented by list: the running sum less what the lists before it hold.
    """
    doc = pc.list_parent_indices(tokens)
    ids = pc.list_flatten(tokens)
    running = pc.cumulative_sum(pc.take(widths, ids))
    own = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(own)])
    upto = np.concatenate([[0], running.to_numpy(zero_copy_only=False)])[at]
    in_text = pc.subtract(running, pc.take(pa.array(upto[:-1], pa.int64()), doc))
    start = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])[:-1], pa.int64())
    return pa.table({"key": pc.add(pc.take(start, doc), in_text), name: ids, f"{name}_doc": doc})


def links(a: pa.Table, b: pa.Table) -> pa.Table:
    """(key, doc, a, b, both) for each overlap of an A token with a B token, in order of bytes.

    Two tokens overlap in one stretch, which ends where either does. A full outer join on the ends finds the stretches;
    the token that goes on past an end is the one whose own end comes next.
    """
    met = a.join(b, "key", join_type="full outer", use_threads=False).combine_chunks()
    met = met.take(pc.sort_indices(met["key"]))
    both = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"]))
    fill = lambda c: pc.fill_null_backward(met[c].combine_chunks())
    return pa.table({"key": met["key"], "doc": pc.coalesce(met["a_doc"], met["b_doc"]), "a": fill("a"), "b": fill("b"), "a_ends": pc.is_valid(met["a"]), "b_ends": pc.is_valid(met["b"]), "both": both})


def _grouped(ids: pa.Array, last: np.ndarray) -> pa.Array:
    """Comma-joined ids of each group; `last` marks a group's last token."""
    offsets = np.concatenate([[0], np.flatnonzero(last) + 1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.cast(ids, pa.string())), ",")


def _chunkless(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _joined(old, new):
    return _chunkless(pa.chunked_array([_chunkless(old), _chunkless(new)]))


#: Cuts a text before each space that follows a character that is no white space.
_UNIT = re.compile(r"\s*\S+(?:(?! )\s+\S*)*|\s+")


class _Block:
    """The units of one block of documents and the pairs of ids met in them, each by number.

    Both tokenizers end a token where a unit ends, so equal units are tokenized and laid over each other once. Where one of
    them might not, whole texts are the units.
    """

    def __init__(self, name: int, two: tuple[BytePairs, Pieces], tables: dict[str, pa.Array]):
        self.name, self.size, self.two, self.tables = name, 0, two, tables
        self.apart = two[0].apart and two[1].apart
        self.known: dict[str, int] = {}
        self.pairs, self.docs = pa.array([], pa.int64()), np.zeros(0, np.int64)
        self.units = pa.table({"good": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_a", "n_b", "n_groups")}, "groups": pa.array([], pa.string()), "numbers": pa.array([], pa.list_(pa.int64()))})

    def cut(self, text: str) -> list[str]:
        return _UNIT.findall(" " + text) if self.apart else [" " + text]

    def add(self, new: list[str]) -> None:
        """Tokenizes new units and lays their tokens over each other."""
        a, b = _lists(self.two[0].encode(new)), _lists(self.two[1].encode(new))
        raw = [u.encode() for u in new]
        good = _faithful(a, self.tables["a"], raw) & _faithful(b, self.tables["b"], raw)
        if not good.all():  # one that isn't given back has no tokens
            none = pa.array([], pa.int32())
            a, b = (pa.array([x if g else none for x, g in zip(t, good, strict=True)], pa.list_(pa.int32())) for t in (a, b))
        sizes = pa.array([len(r) if g else 0 for r, g in zip(raw, good, strict=True)], pa.int64())
        met = links(ends(a, self.tables["a_width"], sizes, "a"), ends(b, self.tables["b_width"], sizes, "b"))
        n = len(new)
        per = met.group_by("doc", use_threads=False).aggregate([([], "count_all"), ("both", "sum")])
        n_links, n_groups = np.zeros(n, np.int64), np.zeros(n, np.int64)
        n_links[per["doc"].to_numpy()], n_groups[per["doc"].to_numpy()] = per["count_all"].to_numpy(), per["both_sum"].to_numpy()
        a_last, b_last = (met["both"].filter(met[e]).to_numpy() for e in ("a_ends", "b_ends"))
        group = pc.binary_join_element_wise(_grouped(pc.list_flatten(a), a_last), _grouped(pc.list_flatten(b), b_last), "|")
        pair = _chunkless(pc.add(pc.shift_left(pc.cast(met["a"], pa.int64()), 32), pc.cast(met["b"], pa.int64())))
        unseen = pc.unique(pair)
        self.pairs = _joined(self.pairs, unseen.filter(pc.is_null(pc.index_in(unseen, self.pairs))))
        self.docs = np.concatenate([self.docs, np.zeros(len(self.pairs) - len(self.docs), np.int64)])
        numbers = pa.ListArray.from_arrays(_offsets(n_links), pc.cast(pc.index_in(pair, self.pairs), pa.int64()))
        groups = pc.binary_join(pa.ListArray.from_arrays(_offsets(n_groups), _chunkless(group)), ";")
        count = lambda x: pc.cast(pc.list_value_length(x), pa.int64())
        more = pa.table({"good": pa.array(good), "n_a": count(a), "n_b": count(b), "n_groups": pa.array(n_groups), "groups": groups, "numbers": numbers})
        self.units = pa.concat_tables([self.units, more]).combine_chunks()

    def documents(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Columns for some documents: their units put together, and their links counted by pair."""
        cuts = [self.cut(t) if t else [] for t in texts]
        known = self.known
        new = [u for u in dict.fromkeys(itertools.chain.from_iterable(cuts)) if u not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.add(new)
        lists = pa.ListArray.from_arrays(_offsets(list(map(len, cuts))), pa.array([known[u] for c in cuts for u in c], pa.int64()))
        good = pc.take(self.units["good"], pc.list_flatten(lists))
        bad = pc.unique(pc.filter(pc.list_parent_indices(lists), pc.invert(_chunkless(good)))).to_pylist()
        if bad:  # one unit that isn't given back leaves a document without tokens
            gone = set(bad)
            lists = pa.array([[] if i in gone else u for i, u in enumerate(lists)], pa.list_(pa.int64()))
        at, unit = lists.offsets.to_numpy(), pc.list_flatten(lists)

        def total(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[at])

        of = lambda c: _chunkless(pc.take(self.units[c], unit))
        n_a, n_b, n_groups = (total(of(c).to_numpy()) for c in ("n_a", "n_b", "n_groups"))
        numbers = of("numbers")
        n_links = total(pc.list_value_length(numbers).to_numpy(zero_copy_only=False))
        docs = pc.take(pc.list_parent_indices(lists), pc.list_parent_indices(numbers))
        own = pa.table({"doc": docs, "number": pc.list_flatten(numbers)}).group_by(["doc", "number"], use_threads=False).aggregate([([], "count_all")])
        own = own.take(pc.sort_indices(own["doc"])).combine_chunks()
        part = own.group_by("number", use_threads=False).aggregate([([], "count_all")])
        self.docs[part["number"].to_numpy()] += part["count_all"].to_numpy()
        rows = _offsets(np.bincount(own["doc"].to_numpy(), minlength=len(texts)))
        return {
            "n_a": pa.array(n_a, pa.int64()),
            "n_b": pa.array(n_b, pa.int64()),
            "n_groups": pa.array(n_groups, pa.int64()),
            "n_links": pa.array(n_links, pa.int64()),
            "groups": pc.binary_join(pa.ListArray.from_arrays(lists.offsets, of("groups")), ";"),
            "numbers": pa.ListArray.from_arrays(rows, pc.cast(_chunkless(own["number"]), pa.int32())),
            "times": pa.ListArray.from_arrays(rows, pc.cast(_chunkless(own["count_all"]), pa.int32())),
        }


NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "numbers", "times", "pairs", "docs"]


def align_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of both tokenizers laid over each other: one row a document, and one row a block of documents with its pairs.

    A document's row has (id, n_a, n_b, n_groups, n_links, groups) and its links as numbers of pairs in its block, each with the
    times it occurs. A block's row has `pairs` (A id << 32 | B id, by number) and, in `docs`, how many documents of the block link
    them; there the rest is null. `groups` is `a1,a2|b1;a3|b2,b3`.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = _tokenizers(path_a, path_b)
        tables = {"a": pa.array(two[0].bytes, pa.binary()), "b": pa.array(two[1].bytes, pa.binary())}
        tables |= {f"{k}_width": pc.cast(pc.binary_length(v), pa.int64()) for k, v in tables.items()}
        first = TaskContext.get().partitionId() << 32
        block, made, types = _Block(first, two, tables), 0, None

        def close() -> pa.RecordBatch:
            own = {"block": pa.array([block.name], pa.int64()), "pairs": pa.array([block.pairs], pa.list_(pa.int64())), "docs": pa.array([block.docs], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(1, t) for c, t in zip(NAMES, types, strict=True)], NAMES)

        for whole in batches:
            for at, n in steps(whole.column(1), STEP_BYTES):
                batch = whole.slice(at, n)
                got = block.documents(batch.column(1).to_pylist())
                got |= {"id": batch.column(0), "block": pa.array([block.name] * n, pa.int64()), "pairs": pa.nulls(n, pa.list_(pa.int64())), "docs": pa.nulls(n, pa.list_(pa.int64()))}
                out = pa.RecordBatch.from_arrays([_chunkless(got[c]) for c in NAMES], NAMES)
                types = out.schema.types
                yield out
                block.size += batch.column(1).nbytes
                if block.size >= BLOCK_BYTES:
                    yield close()
                    made += 1
                    block = _Block(first + made, two, tables)
        if block.size:
            yield close()

    long, longs, ints = T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    types = [kind, long, long, long, long, T.StringType(), long, ints, ints, longs, longs]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(NAMES, types, strict=True)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(in_block, number, n, best) for each block's pairs: the documents of the corpus that link the pair, and if no pair of its A id has more."""
    parts = aligned.filter("pairs is not null").select(F.col("block").alias("in_block"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("number", "p"))
    parts = parts.select("in_block", "number", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    # An A id has at most as many partners as the other vocabulary has entries.
    counts = parts.groupBy("pair").agg(F.sum("docs").alias("n"))
    best = F.col("n") == F.max("n").over(W.partitionBy(F.shiftright("pair", 32)))
    return parts.select("in_block", "number", "pair").join(counts.select("pair", "n", best.alias("best")), "pair").select("in_block", "number", "n", "best")


def _score(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Links of one block's documents with their counts, summed by document."""
    order = pc.sort_indices(counts["number"])
    n, best = (counts[c].take(order).to_numpy() for c in ("n", "best"))
    lists = docs["numbers"].combine_chunks()
    numbers, times = (pc.list_flatten(docs[c].combine_chunks()).to_numpy() for c in ("numbers", "times"))
    table = pa.table({"doc": pc.list_parent_indices(lists), "n_best": times * best[numbers], "count_sum": times * n[numbers]})
    sums = table.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
    place = sums["doc"].to_numpy()
    out = {c: np.zeros(len(docs), np.int64) for c in ("n_best", "count_sum")}
    for c, values in out.items():
        values[place] = sums[f"{c}_sum"].to_numpy()
    return docs.drop_columns(["block", "numbers", "times"]).append_column("n_best", pa.array(out["n_best"])).append_column("count_sum", pa.array(out["count_sum"]))


def score_links(aligned: DataFrame) -> DataFrame:
    """Documents of a written `align_texts` table with n_best and count_sum; it is read twice.

    A block's counts and its documents' links meet by block, both of a size that the block's text bounds.
    """
    docs = aligned.filter("pairs is null").drop("pairs", "docs")
    kept = [f for f in docs.schema.fields if f.name not in ("block", "numbers", "times")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return docs.groupBy("block").cogroup(link_counts(aligned).groupBy("in_block")).applyInArrow(_score, schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: (id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum).

    A encodes a space and the text, B the text, to which it adds the space. Where an A and a B token end at one byte, a group
    ends. Every overlap of two tokens is a link; the count of a pair of ids is the number of documents of the corpus that link
    them. `n_best` counts the links whose pair has the highest count of its A id (ties too), `count_sum` sums the counts of all
    links. With `digest`, `groups` is its SHA-256 in hex, '' for documents without tokens.

    Cases: texts that are null, empty or not given back byte for byte by both tokenizers have no tokens, zeros and no groups;
    rows with null or repeated ids are documents of their own; other columns are not read; a long text is one step and block;
    an empty table gives an empty result. Groups of over 2 GB don't fit a Spark value.
    """
    found = align_texts(docs, path_a, path_b, id_col, text_col)
    if digest:
        found = found.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    return score_links(materialize(found, "aligned")).withColumnRenamed("id", id_col)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer over every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
