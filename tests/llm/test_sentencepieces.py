"""SentencePiece encoding with offsets against the library, on the public model and on the same with other normalisers."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tessera.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b  ", "▁", "x▁y ▁ z", "é漢字😀 \x00\n\t", "￾", "a b", "<s> </s> <unk> <0x41>", "▁▁a▁", "a" * 1000 + " " * 50 + "b", "漢" * 100]
LETTERS = [" ", "  ", "ａ", "ﬁ", "①", "é", "é", "漢", "가", "가", " ", "　", "\x00", "\t", "\n", "½", "x", "the", "😀", "Å", "İ", "ß", "▁"]


def words(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))


def changed(tmp_path, **spec):
    model = pb.ModelProto.FromString(open(PATH, "rb").read())
    rule = spec.pop("rule", None)
    if rule:
        made = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    for k, v in spec.items():
        setattr(model.normalizer_spec, k, v)
    path = tmp_path / "changed.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_spans_and_decoding(library):
    rng = random.Random(13)
    texts = ODD + [words(rng, " ▁ab漢\n.1😀é", 40) for _ in range(500)]
    coder = S.Encoder(PATH)
    for text, (ids, starts, ends) in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        data = text.encode()
        assert starts[1:].tolist() == ends[:-1].tolist() and (not len(ids) or (starts[0] == 0 and ends[-1] == len(data)))
        for i, a, b in zip(ids.tolist(), starts, ends):
            piece = library.id_to_piece(i)
            want = bytes([int(piece[3:5], 16)]) if library.is_byte(i) else None
            assert data[a:b] == want if want else data[a:b].decode().replace(" ", "▁") in (piece, piece[1:])
        assert coder.decode(np.array([1, *ids, 2])) == library.decode(library.encode(text, add_bos=True, add_eos=True))


@pytest.mark.parametrize("spec", [{"rule": "nmt_nfkc", "remove_extra_whitespaces": True}, {"rule": "nfkc_cf"}, {"add_dummy_prefix": False}, {"rule": "nfkc", "remove_extra_whitespaces": True, "add_dummy_prefix": False}])
def test_longest_prefix_normalisation(tmp_path, spec):
    path = changed(tmp_path, **spec)
    own, library = S.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    plain = sentencepiece.SentencePieceNormalizer(model_file=path)
    rng = random.Random(7)
    for _ in range(1500):
        text = words(rng, LETTERS, 12)
        want, offsets = plain.normalize(text, with_offsets=True)
        got, source = own.normalize(text)
        assert got == want
        assert own.encode([text])[0][0].tolist() == library.encode(text)
        if want:  # the library counts characters
            at = [len(got[:i].encode()) for i in range(len(got) + 1)]
            assert [len(text.encode()[: source[b]].decode()) for b in at] == list(offsets)


def test_user_defined_pieces_are_kept_as_they_are(tmp_path):
    path = changed(tmp_path, rule="nfkc")
    model = pb.ModelProto.FromString(open(path, "rb").read())
    model.pieces[31_999].piece, model.pieces[31_999].type = "ﬁ①", S._USER_DEFINED
    open(path, "wb").write(model.SerializeToString())
    own, library = S.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("ﬁ①", "ﬁx ﬁ① ①", "xﬁ①ﬁ"):
        assert own.encode([text])[0][0].tolist() == library.encode(text)


def test_long_texts_go_in_runs_of_words(library, monkeypatch):
    text = "some words  of a text\nthat goes on ▁ and on " * 300
    want = S.Encoder(PATH).encode([text, "x " * 500 + "y" * 900])
    monkeypatch.setattr(S, "RUN_CHARS", 37)
    got = S.Encoder(PATH).encode([text, "x " * 500 + "y" * 900])
    assert want[0][0].tolist() == library.encode(text)
    assert all(np.array_equal(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_whole_query(spark, tmp_path, library):
    texts = [*ODD, None, "repeated", "repeated", "long words " * 20_000]
    rows = [(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "covered")) for r in S.op13_sentencepiece(spark, str(tmp_path)).collect())
    want = []
    for t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert got == sorted(want)
    assert S.encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_steps_hold_whole_rows():
    import pyarrow as pa

    assert list(S.steps(pa.array(["aaaa", None, "bb", "c" * 50, "", "d"]), most=8)) == [(0, 3), (3, 1), (4, 2)]
    assert list(S.steps(pa.array([], pa.string()))) == []
