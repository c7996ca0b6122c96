"""Tokenizer alignment against a plain version over the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment as A

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WHITE = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　"]
ODD = ["a", "The", "é", "漢", "1", "½", ".", "'s", "'S", "😀", "<|endoftext|>", "</s>", "<0x41>", "\x00", "́", "​", "_", "ß", "the", "ing"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def plain_tokens(text, libraries):
    a, b = libraries
    letters = A.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    place = lambda ids, parts: [(i, sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k, i in enumerate(ids)]
    return place(ids_a, bytes_a), place(ids_b, bytes_b)


def plain(texts, libraries):
    """Per text the eight values, by comparing each A token with each B token."""
    found = [plain_tokens(t or "", libraries) for t in texts]
    links = [[(a, b) for a, s, e in x for b, u, v in y if s < v and u < e] for x, y in found]
    counts = Counter(p for ps in links for p in set(ps))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (x, y), ps in zip(found, links):
        groups, said = [], ""
        if x:
            cuts = sorted({e for *_, e in x} & {e for *_, e in y})
            low = 0
            for c in cuts:
                groups.append("|".join(",".join(str(i) for i, s, e in z if s >= low and e <= c) for z in (x, y)))
                low = c
            said = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(x), len(y), len(groups), len(ps), sum(counts[p] == best[p[0]] for p in ps), sum(counts[p] for p in ps), said))
    return out


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def fixture_texts():
    rng = random.Random(12)
    texts = ["", None, " ", "plain words and more words", "plain words and more words", "x▁y", "漢字😀é \x00", " two  spaces \n\n new line\n  b ", "trailing \n", "a" * 300]
    texts += ["".join(rng.choice(ODD + [" "] * 8 + WHITE) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    return texts + ["▁" + "word " * 50, "several words of one text " * 40]


@pytest.mark.parametrize("block", [A.BLOCK_BYTES, 200])
def test_whole_query(spark, tmp_path, libraries, monkeypatch, block):
    texts = fixture_texts()
    rows = [(None if i == 4 else i // 2, t, "x", 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, pairs string, block int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    monkeypatch.setattr(A, "STEP_BYTES", block // 4)
    got = A.op12_tokenizer_alignment(spark, str(tmp_path))
    assert dict(got.dtypes)["doc_id"] == "bigint"
    assert sorted(tuple(r[f] for f in FIELDS) for r in got.collect()) == sorted(plain(texts, libraries))


def test_rank_merger_gives_the_library_s_ids(libraries):
    coder = A.BytePairs(PATH_A)
    assert coder.apart
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(ODD + WHITE * 2) for _ in range(rng.randint(1, 15)))
        assert list(coder.encode([text])[0]) == libraries[0].encode(text, add_special_tokens=False).ids


def test_units_are_whole_texts_where_tokens_may_go_on(spark, tmp_path, libraries):
    """A pre-tokenizer without the pattern merges over spaces; the library then gets whole texts."""
    spec = json.load(open(PATH_A, encoding="utf-8"))
    spec["pre_tokenizer"]["use_regex"] = False
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec))
    coder = A.BytePairs(str(path))
    assert not coder.apart
    own = Tokenizer.from_file(str(path))
    own.encode_special_tokens = True
    texts = ["of the people. and so on", "plain words and more words in the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in A.align(docs, str(path), PATH_B).collect()}
    for i, (n_a, n_b, n_groups, n_links, *_, said) in enumerate(plain(texts, (own, libraries[1]))):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, n_links)
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == said


def test_empty_and_long(spark, libraries):
    schema = "doc_id long, text string"
    assert A.align(spark.createDataFrame([], schema), PATH_A, PATH_B).count() == 0
    long = "some words that go on " * 30_000
    r = A.align(spark.createDataFrame([(1, long)], schema), PATH_A, PATH_B).first()
    a, b = len(libraries[0].encode(" " + long, add_special_tokens=False).ids), len(libraries[1].encode(long))
    assert (r["n_a"], r["n_b"], r["n_links"]) == (a, b, a + b - r["n_groups"])
    only = A.align(spark.createDataFrame([(1, None), (2, "")], schema), PATH_A, PATH_B).collect()
    assert [tuple(r)[1:] for r in only] == [(0, 0, 0, 0, "", 0, 0)] * 2
