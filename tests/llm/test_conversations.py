"""Conversation repair against all edit sequences of small conversations, and its cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind int, absent boolean"
NOTHING = hashlib.sha256(b"").hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, True) for r in rows], SCHEMA)


def sort_key(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, text)


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edits of every row, insertions of up to two rows anywhere: the least (cost, audit, lines)."""
    best = None
    inserted = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product("DKRS", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
            continue
        for more in itertools.product(inserted, repeat=len(rows) + 1):
            cost, audit, said = 0, "", []
            for i in range(len(rows) + 1):
                cost += 3 * len(more[i])
                audit += "I" * len(more[i])
                said += [(r, "") for r in more[i]]
                if i < len(rows):
                    e = edits[i]
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if faults[i] == "truncated" and e != "D" else 0)
                    audit += {"S": "R"}.get(e, e)
                    if e != "D":
                        said.append(({"K": rows[i][1], "R": "user", "S": "assistant"}[e], rows[i][2]))
            if best and (cost, audit) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in said)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in said))
    return best


def plain(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=sort_key)
    faults = plain_faults(rows)
    cost, audit, text = cheapest(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    initials = "".join(r[:1] or "?" for _, r, _ in rows)
    illegal = sum(p not in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:])))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_cheapest_repair_of_all(spark):
    rng = random.Random(11)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, ""], ["a b.", "c!", "no end", "", " \t", "why? ", None]
    convs = {c: [(rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 3))] for c in range(60)}
    convs |= {c: [(i, r, t) for i, (r, t) in enumerate(zip(rs, ["a.", "b", "c."]))] for c, rs in enumerate(itertools.product(["system", "user", "assistant"], repeat=3), 100)}
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    got = {int(r["conv"]): tuple(r[f] for f in FIELDS) for r in C.summaries(C.as_rows(table(spark, rows))).collect()}
    assert got == {c: plain(rs) for c, rs in convs.items() if rs}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        act = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        if act:
            x = "" if act == 1 else re.sub("[.!?]", "", x) if act == 2 else x
            out += [(t, "user" if act == 4 else r, x)] * (2 if act == 3 else 1)
    return out


def test_damage_and_whole_query_on_small_tables(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["x y.", "z", "w?", None])) for c in [*range(80), None] for t in range(2 if c != 5 else 1)]
    rows += [(None, None, None, None), (700, None, "user", "a."), *[(c, 0, "user", "b.") for c in range(800, 860)]]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in C.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        left = damage([r for r in rows if r[0] == c])
        want[c] = plain(left) if left else (0, 0, 0, 0, 0, 0, "", NOTHING)
    assert got == want
    assert any(not damage([r for r in rows if r[0] == c]) for c in want), "a conversation is dropped whole"


def test_repaired_turns_have_the_digest_and_survive_batches(spark):
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"turn {t}" + "." * (t % 5 > 0)) for t in range(900)] + [(2, 0, "user", "x.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        said = C.as_rows(table(spark, rows))
        one = {r["conv"]: r for r in C.summaries(said).collect()}
        turns = C.repaired_turns(said).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for conv, n in (("1", 900), ("2", 1)):
        mine = sorted((r for r in turns if r["conv"] == conv), key=lambda r: r["position"])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == one[conv]["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine))
        assert len(one[conv]["audit"]) - one[conv]["audit"].count("I") == n


def test_long_texts_equal_turns_and_empty_tables(spark):
    long = "word " * 100_000
    got = C.summaries(C.as_rows(table(spark, [(1, 3, "user", long), (1, 3, "assistant", "b."), (1, 3, "user", long), (9, 2**62, "user", "a."), (9, -(2**62), "user", "b.")]))).collect()
    got = {r["conv"]: r for r in got}
    assert (got["1"]["duplicate"], got["1"]["truncated"], got["1"]["gaps"]) == (1, 1, 0)
    assert got["9"]["gaps"] == 2**63 - 1
    assert C.summaries(C.as_rows(table(spark, []))).count() == 0


@pytest.mark.parametrize("role", ["user", "assistant"])
def test_a_row_alone_gets_its_partner(spark, role):
    r = C.summaries(C.as_rows(table(spark, [(1, 0, role, "a.")]))).first()
    assert (r["cost"], r["audit"]) == (3, "KI" if role == "user" else "IK")
