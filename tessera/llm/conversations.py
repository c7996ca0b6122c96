"""Operator 11: conversation structure repair, a dynamic programme streamed over secondary-sorted turns."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a state of the repaired conversation so far allows next.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Initials of roles by number; 3 stands for all others, and for none.
INITIALS = "sua"
#: State after a kept row, by state and number of its role's initial.
KEPT = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
#: Role, and state after it, that a state asks for: what a changed or inserted row gets.
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits in ASCII order: delete, insert, keep, change the role.
EDITS = "DIKR"
COST = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED_COST = 3
_NEVER = 1_000_000
_BLANKS = " \t\n\x0b\x0c\r"


def _with_insertions(base: list[tuple[int, str]]) -> tuple[tuple[int, ...], int]:
    """Costs to go by state, less their least, and the packed first edits, when rows may be inserted first."""
    more = lambda q: (COST["I"] + q[0], "I")
    user = min(base[USER], more(base[ASSISTANT]))
    found = [min(base[START], more(user)), min(base[SYSTEM], more(user)), user, min(base[ASSISTANT], more(base[USER]))]
    low = min(c for c, _ in found)
    return tuple(c - low for c, _ in found), sum(EDITS.index(e) << 2 * q for q, (_, e) in enumerate(found))


#: After the last row: what is there stays, or the pattern is filled up.
LAST_COSTS, LAST_EDITS = _with_insertions([(0, "D"), (_NEVER, "D"), (_NEVER, "D"), (0, "D")])


@functools.cache
def _back(ahead: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """One row back: costs to go from before a row, and the first edit of each state in two bits.

    An edit fixes the state after it, so of equally cheap first edits the least letter gives the least audit.
    Costs differ by a bounded amount between states, so few arguments occur and each is worked out once.
    """
    role, fault = kind % 4, kind // 4
    worse = TRUNCATED_COST if fault == TRUNCATED else 0
    base = []
    for state in range(4):
        options = [(COST["D"] + ahead[state], "D")]
        if fault not in (BLANK, DUPLICATE):
            options.append((COST["R"] + worse + ahead[WANTED[state][1]], "R"))
            if role in KEPT[state]:
                options.append((COST["K"] + worse + ahead[KEPT[state][role]], "K"))
        base.append(min(options))
    return _with_insertions(base)


@functools.cache
def _forward(state: int, kind: int, edits: int) -> tuple[tuple[tuple[str, str | None], ...], int, int]:
    """Edits of one row from a state, insertions before it included: (edit, new role) pairs, the state after them, their cost."""
    out, cost = [], 0
    while (edit := EDITS[edits >> 2 * state & 3]) == "I":
        role, state = WANTED[state]
        out.append(("I", role))
        cost += COST["I"]
    role = None
    if edit == "R":
        role, state = WANTED[state]
    elif edit == "K":
        state = KEPT[state][kind % 4]
    cost += COST[edit] + (TRUNCATED_COST if kind // 4 == TRUNCATED and edit != "D" else 0)
    return (*out, (edit, role)), state, cost


def _ending(state: int) -> tuple[list[str], int]:
    """Roles inserted after the last row, and their cost."""
    roles = []
    while EDITS[LAST_EDITS >> 2 * state & 3] == "I":
        role, state = WANTED[state]
        roles.append(role)
    return roles, COST["I"] * len(roles)


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in falling order: each gets its edits by state. Four costs are all that goes from batch to batch."""
    conv, ahead = object(), LAST_COSTS
    for batch in batches:
        edits = []
        for key, kind, absent in zip(batch["conv"].tolist(), batch["kind"].tolist(), batch["absent"].tolist(), strict=True):
            if key != conv:
                conv, ahead = key, LAST_COSTS
            got = 0
            if not absent:
                ahead, got = _back(ahead, kind)
            edits.append(got)
        yield batch.assign(edits=edits)


class _Walk:
    """One conversation in rising order: counters, the state, and what has been written so far."""

    def __init__(self, conv: str | None):
        self.conv, self.state, self.cost, self.audit, self.illegal = conv, START, 0, [], 0
        self.faults = [0, 0, 0, 0]
        self.role_before, self.low, self.high, self.turns = None, None, None, 0
        self.digest, self.position = hashlib.sha256(), 0

    def write(self, role: str, text: str) -> int:
        self.digest.update(f"{chr(10) if self.position else ''}{role}:{text}".encode())
        self.position += 1
        return self.position - 1

    def summary(self) -> tuple:
        gaps = min(self.high - self.low + 1 - self.turns, _MOST) if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_MOST = 2**63 - 1
SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv string, position long, edit string, role string, text string"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _walk(batches: Iterator[pd.DataFrame], turns: bool) -> Iterator[pd.DataFrame]:
    """Rows in rising order: the edits are made. Yields the repaired rows, or a summary of each conversation."""
    names = [c.split()[0] for c in (TURNS if turns else SUMMARY).split(", ")]
    now: _Walk | None = None
    out: list[tuple] = []

    def close() -> None:
        roles, cost = _ending(now.state)
        now.cost += cost
        for role in roles:
            now.audit.append("I")
            at = now.write(role, "")
            if turns:
                out.append((now.conv, at, "I", role, ""))
        if not turns:
            out.append(now.summary())

    for batch in batches:
        columns = (batch[c].tolist() for c in ("conv", "absent", "has_turn", "turn_no", "kind", "edits", "role", "text"))
        for conv, absent, has_turn, turn, kind, edits, role, text in zip(*columns, strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    close()
                now = _Walk(conv)
            if absent:
                continue
            if has_turn and turn != now.high:
                now.low, now.high, now.turns = turn if now.turns == 0 else now.low, turn, now.turns + 1
            now.faults[kind // 4] += 1
            now.illegal += now.role_before is not None and (now.role_before, kind % 4) not in _LEGAL
            now.role_before = kind % 4
            made, now.state, cost = _forward(now.state, kind, edits)
            now.cost += cost
            for edit, new_role in made:
                now.audit.append(edit)
                if edit != "D":
                    said = (new_role, "") if edit == "I" else (new_role or role, text)
                    at = now.write(*said)
                    if turns:
                        out.append((conv, at, edit, *said))
        if out:
            yield pd.DataFrame(out, columns=names)
            out = []
    if now is not None:
        close()
        yield pd.DataFrame(out, columns=names)


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, absent) with the number of the role's initial and the first fault, as `kind`.

    One shuffle, by conversation; that a row repeats an earlier one is seen inside it.
    """
    stripped = F.rtrim("text", F.lit(_BLANKS))
    first = F.substring("role", 1, 1)
    role_no = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    same = W.partitionBy("conv", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition("conv").withColumn("copy", F.row_number().over(same))
    fault = F.when(stripped == "", BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), TRUNCATED)
    return rows.withColumn("kind", (role_no + 4 * F.coalesce(fault, F.lit(NO_FAULT))).cast("int"))


def decided(rows: DataFrame) -> DataFrame:
    """Every row with the edits that are cheapest from it on, in rising order within its conversation.

    Sorted by falling turn, the programme runs back from the end and adds one byte a row: the first edit from each of
    four states. Spark's sort to rising turns, which spills, keeps these bytes and the texts of a giant conversation.
    """
    columns = ["conv", "absent", "has_turn", "turn_no", "role", "text", "copy", "kind"]
    order = columns[2:7]
    marked = faults(rows).withColumns({"has_turn": F.col("turn").isNotNull(), "turn_no": F.coalesce("turn", F.lit(0))})
    falling = marked.sortWithinPartitions("conv", *[F.desc(c) for c in order]).select(*columns, F.lit(0).alias("edits"))
    return falling.mapInPandas(_decide, falling.schema).sortWithinPartitions("conv", *order)


def as_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, absent) for `summaries` and `repaired_turns`: ids as text, null roles and texts as one space."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), or_blank(role_col).alias("role"), or_blank(text_col).alias("text"), F.lit(False).alias("absent")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of `as_rows` after damage by crc32(`conv:turn`) % 20, nulls there one space too.

    0 drops a row (it stays as an absent one, so that its conversation is known), 1 empties its text, 2 takes its
    `[.!?]`, 3 repeats it next to itself with the same turn, 4 makes its role user.
    """
    name = F.concat(F.coalesce("conv", F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    act = F.crc32(name.cast("binary")) % 20
    text = F.when(act <= 1, "").when(act == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(act == 0, "").when(act == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("absent") | (act == 0)).alias("absent"), (act == 3).alias("twice"))
    return rows.withColumn("__copy", F.explode(F.when(F.col("twice"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("twice", "__copy")


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal pairs, cost and audit of the cheapest repair, digest of its result.

    The cheapest edits make the role initials match `(s?(ua)+)?`: keep costs 0, a new role (user or assistant) 3, an
    insertion of an empty user or assistant row 3, a deletion 4; blank rows and rows that repeat an earlier role and text
    must go; a truncated row that stays costs 3 more. Of equally cheap audits the least in ASCII order is taken.

    Cases: null and repeated turns are allowed, nulls come first, equal turns go by role and text; a null conversation id
    is a conversation; a role without one of the three initials, an empty one too, can't be kept; a conversation whose
    rows are all absent has zeros, an empty audit and the digest of nothing; gaps over 2^63 - 1 are given as that; an
    empty table gives an empty result. A conversation streams through one task, which holds four costs, counters, the
    audit and one Arrow batch of it.
    """
    return decided(rows).mapInPandas(functools.partial(_walk, turns=False), SUMMARY)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired rows: (conv, position from 0, edit, role, text); same cases as `summaries`."""
    return decided(rows).mapInPandas(functools.partial(_walk, turns=True), TURNS)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = summaries(damaged(as_rows(turns)))
    return out.select(F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"), *[c for c in out.columns if c != "conv"])


_BEST = "list_sort([{options}])[1]"
_EMPTY = "{{'c': {c}, 'a': '', 'o': ''}}"


def _sql_add(state: str, cost: str, letter: str, line: str | None) -> str:
    """A state's struct after one edit: cost c, audit a, written lines o (each ends in a newline)."""
    written = f"{state}.o" if line is None else f"{state}.o || {line} || chr(10)"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {written}}}"


def _sql_inserted(names: tuple[str, str, str, str]) -> tuple[str, str]:
    start, system, user, assistant = names
    to_user = ", ".join([user, *[_sql_add(q, "3", "I", "'user:'") for q in (start, system, assistant)]])
    to_assistant = ", ".join([assistant, _sql_add("nu", "3", "I", "'assistant:'")])
    return _BEST.format(options=to_user), _BEST.format(options=to_assistant)


def _sql() -> str:
    nu, na = _sql_inserted(("q0", "q1", "q2", "q3"))
    never = _EMPTY.format(c=_NEVER)
    worse = "(case when fault = 'truncated' then 3 else 0 end)"

    def step(same: str, froms: list[tuple[str, str, str]]) -> str:
        """Best of deleting from the same state, and of keeping or changing from others: (state, initial, wanted role or '')."""
        options = [_sql_add(same, "4", "D", None)]
        for q, initial, wanted in froms:
            may = f"fault in ('', 'truncated') and left(role, 1) = '{initial}'"
            options.append(f"case when {may} then {_sql_add(q, worse, 'K', chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')} else {never} end")
            if wanted:
                options.append(f"case when fault in ('', 'truncated') then {_sql_add(q, '3 + ' + worse, 'R', chr(39) + wanted + ':' + chr(39) + ' || text')} else {never} end")
        return _BEST.format(options=", ".join(options))

    to_user = [(q, "u", "user") for q in ("q0", "q1", "na")]
    return f"""
with recursive t as (select list_transform(range(256), lambda n: list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
n as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
a as (select n.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda s: ascii(s)::bigint)), lambda c, b: xor(c >> 8, t.crc[((xor(c, b) & 255) + 1)])), 4294967295) % 20 as act from n, t),
d as (select conv_id, turn, case when act = 4 then 'user' else role end as role,
    case act when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when act = 3 then [1, 2] else [1] end) as copy from a where act <> 0),
e as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from d),
f as (select *, case when s = '' then 'blank' when k > 1 then 'duplicate' when right(s, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from e),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from f group by 1),
w as (select conv_id, 0::bigint as i, {_EMPTY.format(c=0)} as q0, {never} as q1, {never} as q2, {never} as q3 from g
  union all
  select conv_id, i + 1, {step("q0", [])}, {step("q1", [("q0", "s", "")])}, {step("nu", to_user)}, {step("na", [("nu", "a", "assistant")])}
  from (select *, {na} as na from (select w.*, f.role, f.text, f.fault, {nu} as nu from w join f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1))),
z as (select conv_id, list_sort([q0, na])[1] as q from (select *, {na} as na from (select w.*, {nu} as nu from w join g on w.conv_id is not distinct from g.conv_id and w.i = g.n)))
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(q.c, 0)::bigint as cost, coalesce(q.a, '') as audit, sha256(coalesce(left(q.o, greatest(length(q.o) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join g on g.conv_id is not distinct from o.conv_id left join z on z.conv_id is not distinct from o.conv_id
"""


OP11_SQL = _sql()
