"""Operator 3: secret scan with a randomness test battery (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.columns import let
from tessera.plans.session import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Candidates of the battery: maximal runs of encoding characters, padding apart.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Expected share of false reports among the reported tokens of a length band.
FDR = 0.05
#: A token that fails the battery at this level is not reported.
MIN_P = 0.001
#: The alphabets of the encodings, tried in this order, and how often two, and three, symbols of a
#: look-alike coincide: English letters (sums of squared and cubed frequencies), and numbers for the hex alphabets.
ENCODINGS = [
    ("hex", "0123456789abcdef", 0.125, 0.02),
    ("HEX", "0123456789ABCDEF", 0.125, 0.02),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.0667, 0.0055),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 0.0667, 0.0055),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.0667, 0.0055),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.0667, 0.0055),
]
_MARK, _OTHER = "￿", "￾"
_CHUNK = 256
SPAN = "struct<start:bigint,kind:int,end:bigint,token:string>"


def find_spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches of `pattern` as (start, kind, end, token), in code points.

    Matches are framed with a noncharacter (one in the text is first replaced by another, which no
    pattern matches), the text is split there, and lengths are summed up in chunks, so that the cost
    stays near linear in the number of matches.
    """
    framed = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def chunked(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _CHUNK).cast("int")), lambda c: F.slice(parts, c * _CHUNK + 1, _CHUNK))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        span = F.struct(a["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("token"))
        return F.struct(
            end.alias("at"), (~a["hit"]).alias("hit"), F.when(a["hit"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out")
        )

    def spans(chunks: Column) -> Column:
        """A chunk's spans count from its start; they are moved by the lengths of the chunks before it."""
        length = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
        offsets = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + length(p))))
        local = F.transform(chunks, lambda p: F.aggregate(p, start, step, lambda a: a["out"]))
        move = lambda s, by: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["token"].alias("token"))
        moved = F.transform(
            F.arrays_zip(local.alias("spans"), F.slice(offsets, 1, F.size(chunks)).alias("offset")),
            lambda z: F.transform(z["spans"], lambda s: move(s, z["offset"])),
        )
        return F.flatten(moved)

    return F.when(text.rlike(pattern), let(F.split(framed, _MARK, -1), lambda parts: let(chunked(parts), spans))).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, those too short dropped after matching."""
    assign = F.filter(find_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 1)) >= MIN_ASSIGN)
    access = F.filter(find_spans(text, ACCESS, 1), lambda s: F.length(s["token"]) >= MIN_ACCESS)
    # A run of hex digits is maximal, so asking for its length in the pattern drops the same runs.
    return F.concat(assign, access, find_spans(text, f"[0-9a-f]{{{MIN_HEX},}}", 2))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the polynomial 26.2.17 of Abramowitz and Stegun; error below 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding_of(token: Column) -> Column:
    """(alphabet, pairs, triples) of the first encoding that all characters fit; null if none does."""
    rest = lambda alphabet: F.length(F.translate(token, alphabet, "")) == 0
    return F.coalesce(
        *[F.when(rest(a), F.struct(F.lit(a).alias("alphabet"), F.lit(two).alias("pairs"), F.lit(three).alias("triples"))) for _, a, two, three in ENCODINGS]
    )


def randomness(token: Column, encoding: Column) -> Column:
    """(p, p_text) of a token; the cost is linear in its length.

    p: of the hypothesis that the token is drawn uniformly from its alphabet, by three tests and Bonferroni:
    chi-squared of the symbol counts (Wilson-Hilferty), Wald-Wolfowitz runs of the alphabet's lower and
    upper half, and the lag-1 serial correlation of the symbols' places; the last two are two-sided.
    p_text: of the hypothesis that it is a look-alike, whose symbols coincide as in words (or numbers); small
    if the same chi-squared statistic is too low for that. The longer the token, the further apart the two.
    """

    def bound(z: Column) -> Column:
        chars = F.split(z["token"], "")
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow((z["n"] - F.length(F.replace(z["token"], c, F.lit("")))).cast("double"), 2)
        )
        values = F.transform(chars, lambda c: (F.instr(z["alphabet"], c) - 1).cast("double"))
        zero = F.lit(0.0)
        first = F.struct(F.lit(-1.0).alias("before"), *[zero.alias(c) for c in ("high", "runs", "sum", "squares", "cross")])

        def step(s: Column, v: Column) -> Column:
            up, was_up = v >= z["k"] / 2, s["before"] >= z["k"] / 2
            new = (s["before"] < 0) | (up != was_up)
            return F.struct(
                v.alias("before"),
                (s["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"),
                (s["runs"] + F.when(new, 1.0).otherwise(0.0)).alias("runs"),
                (s["sum"] + v).alias("sum"),
                (s["squares"] + v * v).alias("squares"),
                (s["cross"] + F.when(s["before"] < 0, 0.0).otherwise(s["before"] * v)).alias("cross"),
            )

        fold = lambda v: F.struct(F.aggregate(v, first, step).alias("s"), F.get(v, F.lit(0)).alias("first"))
        return let(F.struct(let(values, fold).alias("sums"), squares.alias("squares")), lambda y: judged(z, y["squares"], y["sums"]["s"], y["sums"]["first"]))

    def judged(z: Column, squares: Column, s: Column, first: Column) -> Column:
        n, k = z["n"].cast("double"), z["k"].cast("double")
        chi2, df = squares * k / n - n, k - 1
        cube = F.pow(F.greatest(chi2 / df, F.lit(0.0)), 1 / 3)
        p_chi = _upper_tail((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        n1, runs = s["high"], s["runs"]
        n0 = n - n1
        mean = 2 * n1 * n0 / n + 1
        spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        # All symbols in one half: no run test is possible, and that alone is as rare as 2^(1-n).
        p_runs = F.when((n1 == 0) | (n0 == 0), F.pow(F.lit(2.0), 1 - n)).when(spread > 0, 2 * _upper_tail(F.abs(runs - mean) / spread)).otherwise(1.0)
        # Sums of small integers are exact, so the centred moments may be made from them.
        centre = s["sum"] / n
        var = s["squares"] - n * centre * centre
        cov = s["cross"] - centre * (2 * s["sum"] - first - s["before"]) + (n - 1) * centre * centre
        p_serial = F.when(var > 0, 2 * _upper_tail(F.abs(cov / var + 1 / n) * F.sqrt(n))).otherwise(0.0)
        q, r = z["pairs"], z["triples"] - z["pairs"] * z["pairs"]
        expected = n * (n - 1) * q
        sd = F.sqrt(4 * n * (n - 1) * (n - 2) * r + 2 * n * (n - 1) * (q - q * q))
        p = F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))
        return F.struct(p.alias("p"), _upper_tail((expected - (squares - n)) / sd).alias("p_text"))

    head = lambda e: F.struct(
        token.alias("token"), F.length(token).alias("n"), e["alphabet"].alias("alphabet"), F.length(e["alphabet"]).alias("k"), e["pairs"].alias("pairs"), e["triples"].alias("triples")
    )
    return let(encoding, lambda e: let(head(e), bound))


def random_candidates(text: Column) -> Column:
    """Runs of encoding characters with letters and digits that fit an encoding, with the p-value of being a look-alike.

    It is 1 if the token fails the battery: then it is not random in another way.
    """
    found = F.filter(
        find_spans(text, CANDIDATE, 3), lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]") & encoding_of(s["token"]).isNotNull()
    )
    value = lambda t: let(randomness(t, encoding_of(t)), lambda b: F.when(b["p"] < MIN_P, 1.0).otherwise(b["p_text"]))
    return F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), value(s["token"]).alias("p")),
    )


_BINS_PER_DECADE, _MAX_BIN = 50, 1500


def _band(span: Column) -> Column:
    return F.floor(F.log2((span["end"] - span["start"]).cast("double"))).cast("int")


def _bin(p: Column) -> Column:
    """Small p, large bin; the bin's largest p is 10^(-bin / 50)."""
    return F.least(F.lit(_MAX_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * _BINS_PER_DECADE)).cast("int")


def report_bins(candidates: DataFrame, fdr: float) -> dict[int, int]:
    """Benjamini-Hochberg per length band over all candidates: band -> first bin that is reported.

    The null hypothesis is the look-alike, so the rule bounds the share of false reports. p-values are
    counted in bins, so Spark shuffles at most bands x bins sums, and at most one row for each of the 31
    possible bands comes to the driver.
    """
    bins = candidates.select(F.explode("candidates").alias("c")).select(_band(F.col("c")).alias("band"), _bin(F.col("c.p")).alias("bin"))
    sums = bins.groupBy("band", "bin").count()
    up = W.partitionBy("band").orderBy(F.desc("bin"))
    rank = F.sum("count").over(up)
    total = F.sum("count").over(W.partitionBy("band"))
    passed = F.pow(F.lit(10.0), -F.col("bin") / _BINS_PER_DECADE) <= fdr * rank / total
    rows = sums.withColumn("passed", passed).filter("passed").groupBy("band").agg(F.min("bin").alias("bin")).collect()
    return {r["band"]: r["bin"] for r in rows}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, spans): secrets of each text as (start, kind, end), by start, then kind; one row per input row.

    Kinds 0 to 2 are the fixed patterns. Kind 3 adds runs of 20 or more encoding characters outside
    those spans that are random: the encoding is inferred; the battery (uniformity, runs, serial
    correlation) takes out what isn't uniform; and of the rest, per length band, the false-discovery
    rule reports those whose symbols coincide too rarely for words or numbers. Long tokens tell the
    two apart better, so each band has a threshold of its own.

    Every text is scanned whole in one map, without a shuffle, at a cost linear in the lengths of its
    tokens; what is kept of it are spans.
    Cases: null and empty texts have no spans; offsets are code points; repeated rows repeat; an empty
    table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), base_spans(text).alias("base"), random_candidates(text).alias("candidates"))
    slim = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    found = found.withColumn("base", F.transform("base", slim))
    found = found.withColumn(
        "candidates",
        F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))),
    )
    found = materialize(found, "secrets")
    reported = report_bins(found, fdr)
    first = F.create_map(*[F.lit(x) for kv in reported.items() for x in kv]) if reported else F.expr("cast(map() as map<int,int>)")
    random = F.filter("candidates", lambda c: _bin(c["p"]) >= F.coalesce(F.try_element_at(first, _band(c)), F.lit(_MAX_BIN + 1)))
    return found.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", F.transform(random, slim))).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with the counts and digests of the contract."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
