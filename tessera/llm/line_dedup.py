"""Operator 4: near-duplicate lines by a segment-partition edit join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columns import let
from tessera.llm.exact_dedup import maybe_in, survivor_filter
from tessera.plans.session import materialize

#: Edits that a line may differ by from an earlier one and still be its duplicate.
MAX_EDITS = 1
#: Shorter lines (after normalising) are compared for equality only: one edit makes another word of them.
MIN_CHARS = 20

#: A segment that so many different lines share is too common to join on; its lines are compared by finer keys.
HOT_KEY = 200
#: Slices of a line, of which a finer key leaves out one.
SLICES = 64

#: Letters whose counts screen pairs, five to a long; each count takes 12 bits.
_LETTERS = ("etnai", "oshrl")
_COUNT_BITS, _COUNT_MAX = 12, 4095


def normal_line(line: Column) -> Column:
    """A line as it is compared: lower case, blanks, tabs and carriage returns folded and trimmed."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r")
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, "[\\t\\r ]+", " ")).otherwise(line)))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows as structs with a number each; written, so that the number is the same in every read.

    The caller's columns travel in the struct, so their names meet none of the names used here.
    """
    return materialize(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("no")), "rows")


def _lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, line_no, s) of all lines, normalised before they are exploded, so that each is once."""
    lines = F.transform(F.split(F.col("row").getField(text_col), "\n", -1), normal_line)
    return rows.select(F.col("row").getField(id_col).alias("id"), "no", F.posexplode(lines).alias("line_no", "s"))


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """First place (from 0) and length of segment i of a line: `edits` + 1 segments as even as possible."""
    first = F.floor(length * i / (edits + 1)).cast("int")
    return first, F.floor(length * (i + 1) / (edits + 1)).cast("int") - first


def _key(line: Column, length: Column, i: int, at: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, at + 1, size))


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """One key for each segment: hash of (line length, segment number, segment)."""
    return [_key(line, length, i, *_segment(length, i, edits)) for i in range(edits + 1)]


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys of the substrings that can equal a segment of a line no longer than this one, but the line's own segments.

    For an indexed line shorter by `less`, segment i that is free of edits stands at most i places to
    either side, and the parts after it allow at most `edits` - i more shifts; so only substrings with
    max(-i, less - (edits - i)) <= shift <= min(i, less + edits - i) are looked up.
    """
    keys = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                if less or shift:
                    at, size = _segment(length - less, i, edits)
                    ok = (at + shift >= 0) & (at + shift + size <= length)
                    keys.append(F.when(ok, _key(line, length - less, i, at + shift, size)))
    return keys


def hole_keys(line: Column, length: Column, less: int) -> Column:
    """For each slice of a line, shorter by `less`, the hash of all the rest: a line within one edit shares the key of the edit's slice."""
    n = length - less

    def key(j: Column) -> Column:
        a, b = (F.floor(n * k / SLICES).cast("int") for k in (j, j + 1))
        return F.xxhash64(n, j, F.substring(line, F.lit(1), a), F.substring(line, b + 1 + less, n - b))

    return F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), key)


def letter_counts(line: Column, length: Column) -> list[Column]:
    """Counts of some letters, packed into longs."""
    out = []
    for letters in _LETTERS:
        packed = F.lit(0).cast("long")
        for letter in letters:
            n = F.least(F.lit(_COUNT_MAX), length - F.length(F.replace(line, F.lit(letter), F.lit(""))))
            packed = F.shiftleft(packed, _COUNT_BITS).bitwiseOR(n.cast("long"))
        out.append(packed)
    return out


def counts_allow(a: list[Column], b: list[Column], edits: int) -> Column:
    """Whether the letter counts of two lines allow that distance: an edit changes two counts by one at most."""
    gaps = []
    for own, other, letters in zip(a, b, _LETTERS, strict=True):
        for k in range(len(letters)):
            x, y = (F.shiftright(c, k * _COUNT_BITS).bitwiseAND(F.lit(_COUNT_MAX).cast("long")) for c in (own, other))
            gaps.append(F.abs(x - y))
    return (sum(gaps[1:], gaps[0]) <= 2 * edits) & (F.greatest(*gaps) <= edits)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within an edit distance: banded bit-parallel dynamic programming.

    A column of the table is kept as two bit vectors of vertical differences over the 2 x edits + 1
    diagonals around the main one, and one fold over the characters of `b` updates them. The band has
    to fit a long: edits <= 30. Outside the band all distances exceed the limit.
    """
    width = 2 * edits + 1
    mask = F.lit((1 << width) - 1).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    m, n = F.length(a), F.length(b)
    # The characters of a are bound once as a variable; a column would be split again at every step.
    bound = F.struct(F.split(a, "").alias("rows"), m.alias("m"))
    inverse = lambda x: F.bitwise_not(x).bitwiseAND(mask)

    def start(x: Column) -> Column:
        vp = F.lit(((1 << (edits + 1)) - 1) << edits).cast("long")
        return F.struct(vp.alias("vp"), zero.alias("vn"), F.least(F.lit(edits), x["m"]).alias("d"), F.lit(0).alias("j"))

    def fold(ab: Column) -> Column:
        rows, m = ab["rows"], ab["m"]

        def step(s: Column, ch: Column) -> Column:
            # j columns are done; bit k stands for row j + 1 - edits + k
            j, vp, vn = s["j"], s["vp"], s["vn"]
            x = zero
            for k in range(width):
                x = x.bitwiseOR(F.when(F.get(rows, j - edits + k).eqNullSafe(ch), F.lit(1 << k).cast("long")).otherwise(zero))
            return let(x, lambda x: let(((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask), lambda d0: finish(s, d0)))

        def finish(s: Column, d0: Column) -> Column:
            vp, vn, j = s["vp"], s["vn"], s["j"]
            hp = vn.bitwiseOR(inverse(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            # Along the lowest diagonal until it meets the last row, then along that row.
            last_row = m + edits - 1 - j
            bit = F.call_function("shiftleft", one, F.greatest(F.lit(0), F.least(last_row, F.lit(width - 1))))
            gain = F.when(j + edits + 1 <= m, F.when(d0.bitwiseAND(F.lit(1 << (width - 1)).cast("long")) == 0, 1).otherwise(0)).otherwise(
                F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
            )
            return F.struct(
                hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + gain).alias("d"), (j + 1).alias("j")
            )

        return F.aggregate(F.split(b, ""), start(ab), step, lambda s: s["d"] <= edits)

    short = F.when((m == 0) | (n == 0), F.greatest(m, n) <= edits)
    return F.when(F.abs(m - n) > edits, False).otherwise(F.coalesce(short, let(bound, fold)))


def line_table(rows: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """(id, no, line_no, digest, k0.., p0.., c0..) for each line of at least `min_chars` characters.

    With `exact_chars`, lines of so many characters and more are there too, without keys (null).
    """
    least = max(min_chars, edits + 1)
    base = _lines(rows, id_col, text_col).withColumn("n", F.length("s")).filter(F.col("n") >= min(least, exact_chars or least))
    s, n = F.col("s"), F.col("n")
    near = (lambda key: F.when(n >= least, key)) if exact_chars else (lambda key: key)
    return base.select(
        "id",
        "no",
        "line_no",
        F.unhex(F.md5("s")).alias("digest"),
        *[near(k).alias(f"k{i}") for i, k in enumerate(index_keys(s, n, edits))],
        *[near(k).alias(f"p{i}") for i, k in enumerate(probe_keys(s, n, edits))],
        *[c.alias(f"c{i}") for i, c in enumerate(letter_counts(s, n))],
    )


def _texts(rows: DataFrame, text_col: str, groups: DataFrame) -> DataFrame:
    """(group, s): the lines of groups (group, first), fetched at their first places."""
    place = groups.select("group", "first.no", "first.line_no")
    lines = _lines(rows, text_col, text_col).drop("id")
    found = maybe_in(lines, survivor_filter(place, "no", "line_no"), "wanted", "no", "line_no")
    return found.filter("wanted").drop("wanted").join(place, ["no", "line_no"]).select("group", "s")


def duplicate_lines(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None, hot_key: int = HOT_KEY) -> DataFrame:
    """(no, line_no) of the lines of `numbered` rows that are duplicates.

    Lines are compared after normalising. Equal lines are one group, which stands where it first
    occurs, by (id, null last, row number, line number). A group is a near-duplicate if it is within `edits` edits of a group
    that occurs earlier; then all of its lines are duplicates, else all but the first are.

    Pairs of groups come from the partition of a line into `edits` + 1 segments, of which one must be
    unchanged. The join carries hashes and letter counts, no text; the counts screen pairs inside the
    join, so lines that share a long passage but differ elsewhere are not emitted. The texts of the
    pairs that remain are fetched and verified. Very frequent lines count once.
    A segment that over `hot_key` different lines share (numbered lines, forms) would bring them together in all
    pairs. With one edit it isn't joined on: its lines, fetched, meet by the hash of all but one of their
    slices, so only lines that agree in 63 of 64 parts are compared. A bitmap of fixed size tells hot keys, to
    both sides alike. With more edits such a segment is a skewed join, which adaptive execution splits.
    """
    lines = materialize(line_table(rows, id_col, text_col, edits, min_chars, exact_chars), "lines")
    keys = [c for c in lines.columns if c[0] == "k"]
    probes = [c for c in lines.columns if c[0] == "p"]
    counts = [f"c{i}" for i in range(len(_LETTERS))]
    groups = lines.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "no", "line_no")).alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*keys, *probes, *counts)]
    )
    # Written, so that the number of a group is the same in every read.
    groups = materialize(groups.withColumn("group", F.monotonically_increasing_id()), "groups")
    index = groups.select(F.explode(F.array(*keys)).alias("key"), "group", *counts).filter("key is not null")
    probe = groups.select(F.explode(F.array(*keys, *probes)).alias("key"), "group", *counts).filter("key is not null")

    def meet(index: DataFrame, probe: DataFrame) -> DataFrame:
        a, b = index.alias("a"), probe.alias("b")
        other = F.col("a.group") != F.col("b.group")
        near = a.join(b, (F.col("a.key") == F.col("b.key")) & other & counts_allow(*([F.col(f"{x}.{c}") for c in counts] for x in "ab"), edits))
        return near.select(F.least("a.group", "b.group").alias("one"), F.greatest("a.group", "b.group").alias("two"))

    hot = materialize(index.groupBy("key").count().filter(F.col("count") > hot_key).select("key"), "hot") if edits == 1 else None
    if hot is not None and not hot.isEmpty():
        bitmap = materialize(survivor_filter(hot, "key"), "hot-bits")
        index, probe = (maybe_in(x, bitmap, "hot", "key") for x in (index, probe))
        common = materialize(index.unionByName(probe).filter("hot").select("group").distinct(), "common")
        lines_of = _texts(rows, text_col, groups.join(common, "group", "left_semi"))
        lines_of = materialize(lines_of.join(groups.select("group", *counts), "group").withColumn("n", F.length("s")), "common-lines")
        own, longer = (hole_keys(F.col("s"), F.col("n"), less) for less in (0, 1))
        finer = lambda keys: lines_of.select(F.explode(keys).alias("key"), "group", *counts)
        cold = meet(index.filter("not hot").drop("hot"), probe.filter("not hot").drop("hot"))
        pairs = cold.unionByName(meet(finer(own), finer(F.concat(own, longer)))).distinct()
    else:
        pairs = meet(index, probe).distinct()
    pairs = materialize(pairs, "pairs")

    ends = pairs.select(F.explode(F.array("one", "two")).alias("group")).distinct()
    ends = materialize(groups.select("group", "digest", "first").join(ends, "group", "left_semi"), "ends")
    at = lambda c: ends.select(F.col("group").alias(c), F.struct("first", "digest", "group").alias(f"{c}_at"))
    pairs = pairs.join(at("one"), "one").join(at("two"), "two")
    pairs = pairs.select(F.least("one_at", "two_at")["group"].alias("early"), F.greatest("one_at", "two_at")["group"].alias("late"))
    pairs = materialize(pairs, "ordered")
    texts = materialize(_texts(rows, text_col, ends), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """The late groups of the pairs that are near; pairs are few bytes but much work, so they are spread."""
        side = lambda c: texts.select(F.col("group").alias(c), F.col("s").alias(f"{c}_s"))
        both = pairs.join(side("early"), "early").join(side("late"), "late")
        both = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return both.filter(within_edits(F.col("early_s"), F.col("late_s"), edits)).select("late").distinct()

    # One near group before it is enough: most groups are settled by their first candidate, the others see all.
    found = materialize(verified(pairs.groupBy("late").agg(F.min("early").alias("early"))), "found")
    found = found.unionByName(verified(pairs.join(found, "late", "left_anti")))
    near_dup = ends.join(found.withColumnRenamed("late", "group"), "group", "left_semi").select("digest", F.lit(True).alias("near"))
    near_dup = materialize(near_dup, "near")

    repeated = groups.select("digest", "first", "n").join(near_dup, "digest", "left").filter("n > 1 or near")
    repeated = materialize(repeated.select("digest", "first.no", "first.line_no", "near"), "repeated")
    found = maybe_in(lines.select("no", "line_no", "digest"), survivor_filter(repeated, "digest"), "wanted", "digest").filter("wanted")
    first = repeated.select("digest", F.struct("no", "line_no").alias("first"), "near")
    return found.join(first, "digest").filter(F.col("near").isNotNull() | (F.col("first") != F.struct("no", "line_no"))).select("no", "line_no")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """The documents without their duplicate lines, with `removed`, the numbers of the lines taken out (from 0).

    All columns of `docs` stay but one of that name, which is replaced; the text is joined anew from the lines that stay.
    Cases: null texts stay null, empty texts empty; a text all of whose lines go is empty; rows that
    share an id, or have none, are told apart by a row number: a line that no earlier row has stays; a null id
    comes last; extra columns may have any name; an empty table gives an empty result. Documents surely
    without duplicates skip the join: a bitmap of fixed size tells them. The join of the others is a
    sort-merge join at every size, as the list of removed lines has no bound.
    """
    rows = numbered(docs)
    gone = duplicate_lines(rows, id_col, text_col, edits, min_chars, exact_chars)
    gone = gone.groupBy("no").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))
    gone = materialize(gone, "gone")
    hit = maybe_in(rows, survivor_filter(gone, "no"), "hit", "no")
    joined = hit.filter("hit").join(gone.hint("merge"), "no", "left")
    out = hit.filter("not hit").withColumn("gone", F.expr("cast(null as array<int>)")).unionByName(joined)
    own = F.col("row").getField(text_col)
    # Set difference of line numbers, linear however many lines go; the split text is bound once.
    both = F.struct(F.split(own, "\n", -1).alias("lines"), F.col("gone").alias("gone"))
    kept = let(both, lambda z: F.transform(F.array_except(F.sequence(F.lit(0), F.size(z["lines"]) - 1), z["gone"]), lambda i: F.get(z["lines"], i)))
    text = F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(own)
    removed = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    return out.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != "removed"], removed.alias("removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after line deduplication: what was removed, and the digest of what is left.

    Equal lines are duplicates at any length but 0, near lines from MIN_CHARS on.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, exact_chars=1)
    return out.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.array_join(F.col("removed").cast("array<string>"), ","), 256).alias("removed_sha256"),
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


#: For one edit: of two near lines the shorter one's first or second half stands at the same end of the other.
OP4_SQL = r"""
with d as (select *, row_number() over (order by doc_id nulls last) as no from documents),
l as (select no, unnest(range(len(p)))::int as line_no, unnest(p) as raw from (select no, string_split(text, chr(10)) as p from d)),
n as (select no, line_no, lower(trim(case when contains(raw, '  ') or contains(raw, chr(9)) or contains(raw, chr(13))
        then regexp_replace(raw, '[\t\r ]+', ' ', 'g') else raw end, ' ')) as s from l),
e as (select *, len(s) as n from n where len(s) >= 1),
g as (select s, any_value(n) as n, min(struct_pack(d := no, l := line_no)) as f from e group by s),
ix as (select s, n, f, n as m, unnest(['a' || left(s, n // 2), 'b' || right(s, n - n // 2)]) as k from g where n >= 20),
pb as (select s, n, f, m, unnest(['a' || left(s, m // 2), 'b' || right(s, m - m // 2)]) as k from (select *, unnest([n, n - 1]) as m from g where n >= 20)),
near as (select distinct case when ix.f > pb.f then ix.s else pb.s end as s from ix join pb on ix.m = pb.m and ix.k = pb.k and ix.s <> pb.s
         where levenshtein(ix.s, pb.s) <= 1),
gone as (select e.no, list(e.line_no order by e.line_no) as r from e join g using (s) left join near on near.s = e.s
         where near.s is not null or g.f <> struct_pack(d := e.no, l := e.line_no) group by 1),
o as (select doc_id, coalesce(r, []) as r, case when r is null then text else
        array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(r, (i - 1)::int)), chr(10)) end as t
      from d left join gone using (no))
select doc_id, len(r)::bigint as n_removed, sha256(array_to_string(r, ',')) as removed_sha256, len(t)::bigint as n_chars_left, sha256(t) as text_sha256 from o
"""
