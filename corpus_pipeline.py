"""The corpus pipeline: five stages over `documents`, each a table that the next one reads.

Cases, for every stage: an empty table gives an empty table; columns beyond those of `documents` are dropped,
whatever their names; nulls in lang, source and n_chars are carried on; a long text is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, line_dedup, mixing, simhash
from tessera.plans.session import materialize

#: A document goes if its language is not one of those learned, or fills less of its letters.
MIN_LANGUAGE_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a learned language that fills enough of the text; the rest go.

    Null and empty texts and those without letters have no language and go; ids are not read, so repeated rows fare
    alike and null ids are no special case.
    """
    model = langid.train(docs)
    return langid.keep_identified(docs.select(*COLUMNS), model, MIN_LANGUAGE_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts, equal ones of any length; a document left without any letter or digit goes.

    Null and empty texts stay. Rows that share an id, or have none, are told apart by a row number, so a line that
    stands nowhere earlier stays; null ids come last.
    """
    out = line_dedup.dedup_lines(docs, exact_chars=1)
    left = F.col("text").rlike(r"[\p{L}\p{N}]")
    return _with_length(out.filter(left | (F.size("removed") == 0)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component (sets of 5-word shingles, cosine 0.8), the one with the smallest id.

    The cosine of two sets is what they share over the root of the product of their sizes; for sets of one size 0.8 is a
    Jaccard similarity of 0.67. It is estimated by 256 bits.

    Null ids come last, and rows that share an id or have none are told apart by a row number; of rows that tie, the
    first by that number stays. Texts without words are one component.
    """
    # Written, so that the number of a row is the same in both reads.
    rows = materialize(docs.select(*COLUMNS).withColumn("row_no", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    found = simhash.similar_documents(rows.select(place.alias("place"), "text"), id_col="place")
    keep = found.filter("place = component_id").select(F.col("place.row_no").alias("row_no"))
    return rows.join(keep, "row_no", "left_semi").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents that are mostly benchmark go.

    Null and empty texts stay; ids are not read; an empty benchmark, or items without text, cut nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_length(decontamination.decontaminate(docs.select(*COLUMNS), benchmark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document that is left, by source; `text_md5` ties a row to its text.

    Null texts have size 0; a null source is a source of its own, the last; rows that share an id, or have none, are
    ordered by id and text, and equal ones get what is left in turn.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "text_md5")


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The learned stages can't be said in SQL; tests hold the pipeline against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
