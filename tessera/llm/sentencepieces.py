"""Operator 13: SentencePiece encoding with byte offsets into the original text, and decoding."""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Text that one step holds at a time, unless a single text is longer.
STEP_BYTES = 4_000_000
#: Longer texts are merged in runs of about this many characters, cut between words.
RUN_CHARS = 500_000
_USER_DEFINED, _BYTE = 4, 6


class CharMap:
    """The compiled character map of a model: a double-array trie from prefixes to replacements, as a dictionary.

    Layout: the trie's size in bytes, the trie's 32-bit units, then the replacements, each ended by a zero byte.
    """

    def __init__(self, compiled: bytes):
        self.replacements: dict[str, str] = {}
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self._collect(np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64), compiled[4 + size :])
        self.lengths: dict[str, list[int]] = {}
        for key in self.replacements:
            self.lengths.setdefault(key[0], []).append(len(key))
        self.lengths = {c: sorted(set(n), reverse=True) for c, n in self.lengths.items()}
        self.starts = re.compile(f"[{''.join(map(re.escape, self.lengths))}]") if self.lengths else None

    def _collect(self, units: np.ndarray, texts: bytes) -> None:
        labels = np.arange(1, 256)
        offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        todo = [(int(offset(units[0])), b"")]
        while todo:
            at, key = todo.pop()
            places = at ^ labels
            inside = places < len(units)
            found = labels[inside][(units[places[inside]] & 0x800000FF) == labels[inside]]
            for label in found.tolist():
                unit, name = int(units[at ^ label]), key + bytes([label])
                below = (at ^ label) ^ offset(unit)
                if unit >> 8 & 1:
                    start = int(units[below]) & 0x7FFFFFFF
                    self.replacements[name.decode()] = texts[start : texts.index(b"\0", start)].decode()
                todo.append((below, name))

    def apply(self, text: str, kept: Callable[[str], re.Match | None] | None = None) -> tuple[str, np.ndarray | None]:
        """Text with the longest mapped prefix replaced at each place, and the source byte of each byte of it, and of its end.

        `kept` matches at the start of what is never replaced. None for the sources: nothing was replaced.
        """
        if self.starts is None:
            return text, None
        out, sources, done, at = [], [], 0, 0
        place = 0  # bytes before `done`

        def copy(upto: int) -> int:
            same = text[done:upto]
            n = len(same.encode())
            out.append(same)
            sources.append(np.arange(place, place + n))
            return place + n

        while hit := self.starts.search(text, at):
            i = hit.start()
            if kept and (same := kept(text, at, i + 1)):
                at = same
                continue
            n = next((n for n in self.lengths[text[i]] if text[i : i + n] in self.replacements), 0)
            if not n:
                at = i + 1
                continue
            place = copy(i)
            new, old = self.replacements[text[i : i + n]], len(text[i : i + n].encode())
            out.append(new)
            sources.append(np.full(len(new.encode()), place))
            place, done, at = place + old, i + n, i + n
        place = copy(len(text))
        return "".join(out), np.concatenate([*sources, [place]])


class Encoder:
    """A model's normaliser with offsets, and its merges."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        self.char_map = CharMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.extra, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        pieces = [p.piece for p in model.pieces]
        own = sorted((p.piece for p in model.pieces if p.type == _USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        # What comes in is normalised already.
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.widths = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.unknown, self.begin, self.end = model.trainer_spec.unk_id, self.whole.bos_id(), self.whole.eos_id()
        # No piece goes on over a space into the next word, so merges never cross a word's start.
        apart = self.escape and not self.suffix and SPACE in pieces and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.apart = re.compile(f"[^{SPACE}](?={SPACE})") if apart else None

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes, and its end, the byte of `text` that it comes from."""
        mapped, source = self.char_map.apply(text, self._own_match if self.own else None)
        data = np.frombuffer(mapped.encode(), np.uint8)
        if source is None:
            source = np.arange(len(data) + 1)
        keep = np.ones(len(data), bool)
        if self.extra:  # spaces at the ends and after another space go, space symbols at the end too
            blank = data == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            keep[len(mapped.rstrip(" " + SPACE if self.escape else " ").encode()) :] = False
        places = np.flatnonzero(keep)
        last = source[places[-1] + 1] if len(places) and self.extra else source[-1]
        if not len(data) or (self.extra and not len(places)):
            return "", np.array([0 if not self.extra else source[-1]])
        bytes_left, source = data[places], source[places]
        space = SPACE if self.escape else " "
        width = len(space.encode())
        source = np.concatenate([np.repeat(source, np.where(bytes_left == 32, width, 1)), [last]])
        body = bytes_left.tobytes().decode().replace(" ", space)
        if self.dummy_prefix and self.suffix:
            return body + space, np.concatenate([source, np.full(width, last)])
        if self.dummy_prefix:
            return space + body, np.concatenate([np.full(width, source[0]), source])
        return body, source

    def _own_match(self, text: str, start: int, stop: int) -> int:
        """End of a user-defined piece that starts at or after `start` and covers the place before `stop`; 0 if none."""
        for m in self.own.finditer(text, start):
            if m.start() >= stop:
                return 0
            if m.end() >= stop:
                return m.end()
        return 0

    def ids(self, normalized: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each normalised text, and how many bytes of it each id covers; long texts go through the merges in runs of words."""
        runs, owner = [], []
        for i, text in enumerate(normalized):
            found = list(self._runs(text))
            runs += found
            owner += [i] * len(found)
        got: list[list[int]] = [[] for _ in normalized]
        widths: list[list[np.ndarray]] = [[] for _ in normalized]
        for i, run, ids in zip(owner, runs, self.merger.encode(runs, num_threads=1), strict=True):
            got[i] += ids
            width = self.widths[ids]
            if self.unknown in ids:  # an unknown piece is as wide as what it stands for
                width = np.array([len(p.encode()) if k == self.unknown else w for p, k, w in zip(self.merger.encode(run, out_type=str), ids, width, strict=True)], np.int32)
            widths[i].append(width)
        return [(np.array(ids, "<u4"), np.concatenate([*w, np.zeros(0, np.int32)])) for ids, w in zip(got, widths, strict=True)]

    def _runs(self, text: str) -> Iterator[str]:
        at = 0
        while self.apart and len(text) - at > RUN_CHARS:
            cut = self.apart.search(text, at + RUN_CHARS)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        if at < len(text):
            yield text[at:]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids without begin and end, and the byte span of the text that each comes from.

        A byte of a replaced prefix comes from the prefix's start; what the normaliser adds has no width.
        """
        normal = [self.normalize(text) for text in texts]
        out = []
        for (ids, widths), (_, source) in zip(self.ids([n for n, _ in normal]), normal, strict=True):
            ends = np.cumsum(widths, dtype=np.int64)
            out.append((ids, source[ends - widths], source[ends]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and model."""
    return Encoder(path)


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n + 1
    if start < len(sizes):
        yield start, len(sizes) - start


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """Pieces of whole texts: (id, n_tokens, ids, starts, ends, decoded).

    `ids` are little-endian unsigned 32-bit integers, with the begin and end ids if asked for; `starts` and `ends` give each
    id's byte span in the UTF-8 of the original text; `decoded` is the text of the ids. Texts are normalised by the longest
    prefix in the model's character map, which records where each byte comes from, then merged, very long ones in runs of whole words.

    Cases: null and empty texts have the begin and end ids only; rows are mapped one by one, so null or repeated ids and
    other columns, which are not read, don't matter; a long text is encoded whole; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        head, tail = [[i] if use else [] for i, use in ((coder.begin, begin), (coder.end, end))]
        for whole in batches:
            for at, n in steps(whole.column(1)):
                batch = whole.slice(at, n)
                all_ids, starts, ends, texts = [], [], [], []
                found = [text or "" for text in batch.column(1).to_pylist()]
                for text, (ids, a, b) in zip(found, coder.encode(found), strict=True):
                    size = len(text.encode())
                    ids = np.concatenate([np.array(head, "<u4"), ids, np.array(tail, "<u4")])
                    all_ids.append(ids)
                    starts.append(np.concatenate([[0] * len(head), a, [size] * len(tail)]))
                    ends.append(np.concatenate([[0] * len(head), b, [size] * len(tail)]))
                    texts.append(coder.decode(ids))
                columns = [batch.column(0), pa.array([len(i) for i in all_ids], pa.int64()), pa.array([i.tobytes() for i in all_ids], pa.binary()), _lists(starts), _lists(ends), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "starts", "ends", "decoded"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("starts", ints), T.StructField("ends", ints), T.StructField("decoded", T.StringType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text; `covered` is where the last span ends."""
    import public_tokenizers

    out = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.array_max("ends").cast("long").alias("covered"))
