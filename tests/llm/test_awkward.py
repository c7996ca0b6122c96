"""Every dealt operator on one awkward table: null ids, nulls in any column, repeated rows, long texts, odd column names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, decontamination, exact_dedup, html, langid, licenses, line_dedup, mixing, secrets, sentencepieces, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, digest string, `__slot` long, hit boolean, label int"
LONG = "some words that go on and on, line after line\n" * 8000
TEXTS = [
    (1, "a plain text with a few words in it"), (1, "a plain text with a few words in it"), (2, None), (None, "the id is null here, dear reader"), (None, None), (3, ""), (4, LONG), (5, "x" * 200_000), (6, "\x00\n\t é 漢字 😀 ￾"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, None, None, None, None, "d", 7, None, None) for i, t in TEXTS], SCHEMA)


def test_row_for_row(spark, table):
    train = spark.createDataFrame([(9, "a plain text with words", "en"), (10, "ein text mit worten", "de")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, "on and on line after line some words that go on and"), (None, "x"), (2, None)], "item_id long, text string")
    fm = toxicity.train(table, spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int"))
    results = {
        "langid": langid.identify(table, langid.train(train)),
        "secrets": secrets.scan_secrets(table),
        "lines": line_dedup.dedup_lines(table),
        "simhash": simhash.near_duplicates(table),
        "exact": exact_dedup.exact_dedup(table),
        "mixing": mixing.mix(table),
        "toxicity": toxicity.score(table, fm),
        "benchmark": decontamination.find_contamination(table, bench),
        "alignment": alignment.align(table, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
        "pieces": sentencepieces.encode_texts(table, public_tokenizers.path("piece_bpe_32k.model")),
    }
    for name, df in results.items():
        assert df.count() == len(TEXTS), name
    lines = {r["doc_id"]: r for r in results["lines"].filter("doc_id = 4").collect()}
    assert len(lines[4]["removed"]) == 7999 and lines[4]["text"] == "some words that go on and on, line after line\n"
    assert results["benchmark"].filter("doc_id = 4 and size(hits) = 1").count() == 1
    assert licenses.license_scan(table).count() == 0


def test_repeated_and_null_ids(spark, table):
    exact = exact_dedup.exact_dedup(table).filter("group_size = 2").collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact if r["doc_id"] == 1} == {(1, 1, True)}
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table).filter("fp = 0").collect()}
    assert near[2] == near[3] == 2
    cut = line_dedup.dedup_lines(table).filter("doc_id is null and text is not null").first()
    assert cut["text"] == "the id is null here, dear reader"
    taken = mixing.mix(table).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    assert taken.filter("t > 3 * s").count() == 0


def test_pages(spark):
    deep = "<div>" * 300 + "deep text" + "</div>" * 300
    rows = [(1, None, None, "q"), (1, "http://h/", deep, None), (None, "http://h/", "<p>x</p>", None), (2, "no url", "<p>" + "w " * 100_000, "q")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, template string"))
    texts = [r["text"] for r in got.collect()]
    assert len(texts) == 4 and "deep text" in texts and "x" in texts and max(map(len, texts)) == 199_999
