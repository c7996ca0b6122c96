"""The pipeline and its stages: a plain Python version row for row, and an awkward table through every stage."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import langid, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# Plain stages: lists of (doc_id, text, lang, source).


def plain_language(rows, model):
    kept = []
    for row in rows:
        words = langid.units(row[1] or "")[0]
        if not words:
            continue
        scores = model.score(words).astype(np.float64)
        best, back = scores[0].copy(), []
        for s in scores[1:]:
            top = int(best.argmax())
            move = best[top] - langid.SWITCH_PENALTY > best
            back.append(np.where(move, top, np.arange(len(best))))
            best = np.where(move, best[top] - langid.SWITCH_PENALTY, best) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        letters = defaultdict(int)
        for k, w in zip(path[::-1], words, strict=True):
            letters[k] += len(w)
        if max(letters.values()) / sum(letters.values()) >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            kept.append(row)
    return kept


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_lines(rows):
    normal = lambda line: re.sub("[\t\r ]+", " ", line).strip(" ").lower()
    first, where = {}, defaultdict(set)
    for k, (i, text, *_) in enumerate(rows):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            if s := normal(line):
                at = (i is None, i or 0, k, n)
                first[s] = min(first.get(s, at), at)
                where[s].add(at)
    by_length = defaultdict(list)
    for s in first:
        if len(s) >= 20:
            by_length[len(s)].append(s)
    near = set()
    for n, group in list(by_length.items()):
        for s in group:
            for z in by_length[n] + by_length[n - 1] + by_length[n + 1]:
                if s != z and first[z] < first[s] and one_edit(s, z):
                    near.add(s)
                    break
    gone = {p for s, at in where.items() for p in at if s in near or p != first[s]}
    out = []
    for k, (i, text, lang, source) in enumerate(rows):
        if text is not None:
            lines = text.split("\n")
            left = [x for n, x in enumerate(lines) if (i is None, i or 0, k, n) not in gone]
            if len(left) < len(lines):
                text = "\n".join(left)
                if not any(c.isalnum() for c in text):
                    continue
        out.append((i, text, lang, source))
    return out


def plain_near(rows):
    fps = [simhash.wide_fingerprint(r[1], 5) for r in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    some = [i for i, f in enumerate(fps) if f]
    at, keys, screens = simhash._wide_keys(np.frombuffer(b"".join(fps[i] for i in some), dtype="<u8").reshape(-1, 4))
    by_key = defaultdict(list)
    for r, k, s in zip(at.tolist(), keys.tolist(), screens.tolist(), strict=True):
        by_key[k].append((some[r], s))
    number = [int.from_bytes(f, "little") for f in fps]
    for group in by_key.values():
        for a, (i, s) in enumerate(group):
            for j, z in group[:a]:
                if (s ^ z).bit_count() <= simhash.SCREEN_BITS and (number[i] ^ number[j]).bit_count() <= simhash.bits_at(0.8):
                    part[find(i)] = find(j)
    first = {}
    for i, f in enumerate(fps):
        part[find(i)] = find(first.setdefault(f, i))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return [rows[min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))] for g in groups.values()]


def plain_benchmark(rows, items):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for _, t in items:
        w = word.findall(low(t))
        k = min(10, len(w))
        if k:
            windows[k] |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = []
    for i, text, lang, source in rows:
        spans = [m.span() for m in word.finditer(low(text))]
        w, hit, cut = [low(text)[a:b] for a, b in spans], set(), set()
        for k, grams in windows.items():
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
        cut = hit  # every hit run is a window or a whole short item at least
        if len(hit) > 0.5 * len(w):
            continue
        if cut:
            pieces, last, p = [], 0, 0
            while p < len(w):
                if p in cut:
                    q = p
                    while q + 1 in cut:
                        q += 1
                    pieces.append(text[last : spans[p][0]])
                    last, p = spans[q][1], q
                p += 1
            text = "".join([*pieces, text[last:]])
        out.append((i, text, lang, source))
    return out


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, _, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    full, left = set(), float(sum(total.values()))
    while True:  # fill by weight; what passes its cap is set to it, and the rest is shared anew
        open_sources = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_sources) if open_sources else 0
        over = [s for s in open_sources if level * weight[s] >= 3.0 * total[s]]
        if not over:
            break
        full |= set(over)
        left -= sum(3.0 * total[s] for s in over)
    target = {s: 3.0 * total[s] if s in full else level * weight[s] for s in order}
    out = []
    for s in order:
        md5 = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
        own = [(hashlib.md5(f"7:{'' if i is None else i}:{md5(t)}".encode()).hexdigest(), i, size(t)) for i, t, _, z in rows if z == s]
        budget = int(target[s])
        epochs, rest, at = (budget // total[s], budget % total[s], 0) if total[s] else (0, 0, 0)
        for _, i, n in sorted(own, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
            out.append((i, s, n, total[s], round(target[s], 6), epochs * n + min(n, max(0, rest - at))))
            at += n
    return out


def as_df(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


def triples(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


def test_pipeline_row_for_row(spark, tmp_path):
    raw = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = next(t for _, t, *_ in raw if t and len(t.split()) > 60)
    raw += [(900, " ".join(some.split()[:40]) + " 2 " + items[0][1] + " ends here", "en", None), (901, "½ ² ①", "en", "x"), (902, None, None, None), (903, "", None, "x"), (904, some.replace(some.split()[30], "other", 1), "en", "b")]
    as_df(spark, raw).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string" if isinstance(items[0][0], str) else "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train(docs)
    plain = {
        "language ID": lambda rows: plain_language(rows, model), "line dedup": plain_lines, "SimHash near-dedup": plain_near,
        "benchmark decontamination": lambda rows: plain_benchmark(rows, items),
    }
    rows, sizes = raw, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        rows = plain[name](rows)
        sizes.append(len(rows))
        assert triples(docs) == sorted(rows, key=str), name
        assert docs.filter("n_chars <> length(text)").count() == 0
    assert len(raw) > sizes[0] > sizes[1] >= sizes[2] >= sizes[3]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=str) == sorted(plain_mix(rows), key=str)
    assert sorted(r["text_md5"] for r in got) == sorted(hashlib.md5(t.encode()).hexdigest() for _, t, *_ in rows)


def test_awkward_rows_through_every_stage(spark, tmp_path):
    """Null ids and sources, repeated rows, null and empty texts, one very long text, an empty table, columns of other names."""
    line = "a plain text with a few words in it"
    rows = [(1, line, None, None), (1, line, None, None), (2, None, "en", "a"), (None, "the id is null here, dear reader", "en", "a"), (None, "the id is null here, dear reader", "en", "a"), (None, None, None, None), (3, "", "en", ""), (4, "\n".join(f"words of line {i} that go on" for i in range(1500)), "en", "b"), (5, "x" * 200_000, "en", "b"), (6, "\x00\n\t é 漢字 😀 ￾", "en", None)]
    spark.createDataFrame([(1, "words of line 7 that go on words of line 8"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = as_df(spark, rows)
    extra = docs.selectExpr("*", "'own' as removed", "1 as `key`", "2 as row_no", "'h' as hits", "3 as slot")
    out = {name: [stage(spark, t, str(tmp_path)) for t in (docs, extra, docs.limit(0))] for name, stage in corpus_pipeline.STAGES}
    for name, (own, wide, none) in out.items():
        assert none.count() == 0 and wide.columns == own.columns and sorted(map(str, own.collect())) == sorted(map(str, wide.collect())), name
        assert own.columns == corpus_pipeline.COLUMNS or name.startswith("mixing")
    ids = {name: sorted((r["doc_id"] for r in own.collect()), key=str) for name, (own, *_) in out.items()}
    assert ids["language ID"] == [1, 1, 4, 5, 6, None, None]  # texts without letters go
    assert ids["line dedup"] == [1, 2, 3, 4, 5, 6, None, None]  # a repeated row has no line of its own
    assert ids["SimHash near-dedup"] == [1, 2, 4, 5, 6, None]  # one row of each text; texts without words are one
    assert ids["benchmark decontamination"] == ids["mixing sources to target weights"] == [1, 1, 2, 3, 4, 5, 6, None, None, None]
    mixed = out["mixing sources to target weights"][0].collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed) and sum(r["size"] for r in mixed if r["doc_id"] == 4) == 7 * 1500


@pytest.mark.parametrize("a, b, near", [("abc", "abd", True), ("abc", "abcd", True), ("abc", "xabc", True), ("abc", "acb", False), ("abc", "abcde", False), ("", "a", True)])
def test_plain_edit(a, b, near):
    assert one_edit(a, b) is near
