"""Operator 6: exact deduplication by progressive refinement (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the survivor filter: 2**23 bits are 256 rows of 4 KB, 1 MB whatever the corpus.
FILTER_BITS = 1 << 23
PREFIX_CHARS = 256
#: Groups with more than this part of all rows are joined by broadcast; there are fewer than that many.
HOT_SHARE = 200


def _slot(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))


def survivor_filter(groups: DataFrame, *cols: str) -> DataFrame:
    """Bitmap rows (__filter_row, __bits) with the slots of the keys in `groups`; at most 1 MB in all."""
    slots = groups.select(_slot(*cols).alias("__slot"))
    return slots.groupBy(F.shiftright("__slot", 15).alias("__filter_row")).agg(
        F.bitmap_construct_agg(F.expr("__slot & 32767")).alias("__bits")
    )


def maybe_in(df: DataFrame, bitmap: DataFrame, flag: str, *cols: str) -> DataFrame:
    """Add `flag`: false only if the key is surely not in the filter. The bitmap has a proven size, so it is broadcast."""
    slot = df.withColumn("__slot", _slot(*cols)).withColumn("__filter_row", F.shiftright("__slot", 15))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast((__slot & 32767) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.expr("cast(__slot & 7 as int)")
    hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0, F.lit(False))
    return slot.join(F.broadcast(bitmap), "__filter_row", "left").withColumn(flag, hit).drop("__slot", "__filter_row", "__bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """Group identical texts: (id, keep_id, group_size, kept, digest), one row per input row.

    Refinement: count rows by byte length; for rows whose length recurs, count (length, hash of the
    first characters); for rows whose pair recurs, hash the full text. Between the steps a bitmap of
    fixed size tells which rows go on; a false positive costs a hash and changes no result. Text is
    never shuffled: the shuffles carry lengths and hashes, pre-aggregated on the map side.
    `digest_all` also hashes the texts that were settled early (else their digest is null).

    Cases: a null text counts as empty, and empty texts are one group. Rows that share text and id
    are counted one by one and are all kept if their id is. Null ids group like others; the largest
    non-null id stays. An empty table gives an empty result. Other columns are not read.
    A hot group meets no single task: counts are pre-aggregated, and the last join broadcasts the fewer
    than 200 groups that hold over a 200th of the rows each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("len"))

    lengths = rows.groupBy("len").count().filter("count > 1")
    step2 = maybe_in(rows, survivor_filter(lengths, "len"), "go", "len")
    prefix = F.when(F.col("go"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS)))
    step2 = step2.withColumn("prefix", prefix)

    pairs = step2.filter("go").groupBy("len", "prefix").count().filter("count > 1")
    step3 = maybe_in(step2, survivor_filter(pairs, "len", "prefix"), "hot", "len", "prefix").withColumn(
        "hot", F.col("hot") & F.col("go")
    )
    digest = F.unhex(F.sha2(F.col("text"), 256))
    step3 = step3.select(
        "id", "hot", (digest if digest_all else F.when(F.col("hot"), digest)).alias("digest"), F.rand(17).alias("r")
    )

    groups = (
        step3.filter("hot").groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    )
    # A group with over a 200th of all rows would burden one task of the join. There are fewer than 200 of
    # them, so they are broadcast; their rows and those settled early then go to random keys that match nothing.
    share = max(1, docs.count() // HOT_SHARE)
    hot = groups.filter(F.col("n") > share).select("digest", F.col("keep").alias("hot_keep"), F.col("n").alias("hot_n"))
    out = step3.join(F.broadcast(hot), "digest", "left")
    open_row = F.col("hot") & F.col("hot_n").isNull()
    out = out.withColumn("k", F.when(open_row, F.col("digest")).otherwise(F.encode(F.col("r").cast("string"), "utf-8")))
    rest = groups.filter(F.col("n") <= share).withColumnRenamed("digest", "k")
    out = out.join(rest, "k", "left")
    out = out.withColumn("keep", F.coalesce("hot_keep", "keep")).withColumn("n", F.coalesce("hot_n", "n"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep") == F.col("id"), F.col("keep").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents; the contract wants every row's SHA-256, so all are hashed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, digest_all=True).withColumnRenamed("digest", "text_sha256")


OP6_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id = g.keep_id as kept, d.text_sha256
from d join g on d.text_sha256 = g.text_sha256
"""
