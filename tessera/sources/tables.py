"""Sources and sinks: trial and gaze tables, amplifier files, file catalogues, notes, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIALS = "onset double, duration double, value int, trial_type string, exemplar int, reaction_time double, response_code int, VTC double, VTC_smoothed double"
GAZE = "timestamps double, timestamps_neon double, time double, eyeleft_pupilDiameter double, eyeright_pupilDiameter double"
_NAME = r"sub-([^_/]+)(?:_[^/]*)?_run-0*(\d+)"


#: Folders of packed tables.
BUCKETS = 64


def _named(df: DataFrame) -> DataFrame:
    """Subject and run from the recording's name: the column `file` of packed files, else the path."""
    path = F.col("file") if "file" in df.columns else F.col("_metadata.file_path")
    return df.withColumns({"subject": F.regexp_extract(path, _NAME, 1), "run": F.regexp_extract(path, _NAME, 2).cast("int")})


def _no_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() == "double"})


def read_trials(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Trial TSVs of many subjects and runs; both come from the file name (run-01 or run-1); NaN becomes null.

    Rows keep their order in the file as trial_idx: one file is one run of a few hundred lines. In packed files a line begins with
    the name of its recording.
    """
    df = spark.read.schema(f"file string, {TRIALS}" if packed else TRIALS).option("enforceSchema", True).csv(path, sep="\t", header=True, nullValue="n/a", nanValue="nan")
    df = _no_nan(_named(df)).drop("file")
    return df.withColumn("trial_idx", F.row_number().over(W.partitionBy("subject", "run").orderBy("onset")) - 1)


def read_gaze(spark: SparkSession, path: str, eyes: str = "both", packed: bool = False) -> DataFrame:
    """Eye-tracking TSVs, packed or one a recording, with `pupil`, the mean of both eyes; eyes='any' takes the one there is."""
    schema = f"file string, {GAZE}" if packed else GAZE
    df = _no_nan(_named(spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="n/a", nanValue="nan"))).drop("file")
    left, right = F.col("eyeleft_pupilDiameter"), F.col("eyeright_pupilDiameter")
    both = (left + right) / 2
    return df.withColumn("pupil", both if eyes == "both" else F.coalesce(both, left, right))


def read_samples_csv(spark: SparkSession, path: str, columns: list[str], skip: int = 12) -> DataFrame:
    """Amplifier CSVs in long form (file, t, trigger, channel, v in volts) (S3).

    `skip` preamble lines and the header go by their content, as rows whose first field is no number;
    `columns` names the fields, with `Time(s)`, `TRIGGER(DIGITAL)` and `CH*`, and first `file` in packed files.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(path, header=False, mode="PERMISSIVE")
    if "file" not in columns:
        raw = raw.withColumn("file", F.col("_metadata.file_path"))
    time = F.expr("try_cast(`Time(s)` as double)")
    rows = raw.withColumn("t", time).filter("t is not null")
    channels = [c for c in columns if c.startswith("CH")]
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), (F.expr(f"try_cast(`{c}` as double)") * 1e-6).alias("v")) for c in channels])
    out = rows.select("file", "t", F.expr("try_cast(`TRIGGER(DIGITAL)` as double)").alias("trigger"), F.explode(pairs).alias("c"))
    return out.select("file", "t", "trigger", "c.*")


def catalog(paths: DataFrame, col: str = "path") -> DataFrame:
    """(path, subject, task, run) parsed from file names."""
    p = F.col(col)
    run = F.regexp_extract(p, r"run-0*(\d+)", 1)
    return paths.select(
        p.alias("path"), F.regexp_extract(p, "sub-([^_/]+)", 1).alias("subject"), F.regexp_extract(p, "task-([^_/]+)", 1).alias("task"), F.when(run != "", run.cast("int")).alias("run")
    ).distinct()


def pick_latest(files: DataFrame, priority: list[str], keys: list[str], name: Column) -> DataFrame:
    """The file per key whose name ends in the first suffix of the list that there is."""
    rank = F.coalesce(*[F.when(name.endswith(s), F.lit(i)) for i, s in enumerate(priority)])
    x = files.withColumn("__k", rank).filter("__k is not null")
    return x.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("__k", name))).filter("__r = 1").drop("__r", "__k")


def write_trials(df: DataFrame, path: str, packed: bool = False) -> None:
    """Trials as TSV with header, a folder per subject and run that `read_trials` knows by its name, and as Parquet beside it.

    Packed, both are written as many recordings to a file, so that files grow with the bytes and not with the subjects.
    """
    name = F.format_string("sub-%s_run-%s", F.col("subject").cast("string"), F.col("run").cast("string"))
    write_tsv(df.withColumn("file", name).drop("subject", "run"), f"{path}/tsv", packed)
    if packed:
        _write_buckets(df, f"{path}/parquet", "errorifexists", BUCKETS)
    else:
        df.write.partitionBy("subject").parquet(f"{path}/parquet")


def write_tsv(df: DataFrame, path: str, packed: bool = False) -> None:
    """TSV files with header, a folder per value of the column `file`; null is written as n/a.

    Packed, the column comes first in every line, and the lines of a recording lie together in one file.
    """
    df = df.select("file", *[c for c in df.columns if c != "file"]).repartition("file")
    out = df.sortWithinPartitions("file").write if packed else df.write.partitionBy("file")
    out.csv(path, sep="\t", header=True, nullValue="n/a")


def _write_buckets(df: DataFrame, path: str, mode: str, buckets: int) -> None:
    bucket = F.pmod(F.xxhash64("subject"), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def write_results(df: DataFrame, path: str, mode: str = "errorifexists", buckets: int = BUCKETS) -> None:
    """Fits and features as Parquet (S7), subjects in a fixed number of folders by their hash, so that files don't grow with subjects."""
    _write_buckets(df, path, mode, buckets)


def parse_folder_notes(notes: DataFrame) -> DataFrame:
    """(path, folder, task, run) from free-text notes with lines like `2024-01-02-11-22-33 task Run 2`."""
    found = F.regexp_extract_all("text", F.lit(r"(\d{4}-[0-9_-]+[^\s]*\s+[^\n]*?\s*[Rr]un\s*\d+)"), 1)
    x = notes.withColumn("m", F.explode(found))
    return x.select(
        "path",
        F.regexp_extract("m", r"^(\S+)", 1).alias("folder"),
        F.trim(F.regexp_extract("m", r"^\S+\s+(.*?)\s*[Rr]un\s*\d+$", 1)).alias("task"),
        F.regexp_extract("m", r"[Rr]un\s*(\d+)$", 1).cast("int").alias("run"),
    )


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
