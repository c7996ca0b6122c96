"""Operators on small fixtures: edges, ties, properties."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import regression as R
from tessera.operators import trials as T
from tessera.operators import windows as X
from tessera.operators.clusters import cluster_series
from tessera.operators.graph import connected_components
from tessera.plans.session import materialize
from tessera.sources import tables as IO


def trials(spark, rts, subject="s", run=1):
    rows = [(subject, run, i, float(x), "city", 1 if x else -1, "city_correct" if x else "city_incorrect") for i, x in enumerate(rts)]
    return spark.createDataFrame(rows, "subject string, run int, trial_idx int, reaction_time double, trial_type string, response_code int, condition string")


def test_vtc_without_presses_and_at_ends(spark):
    v = [r["VTC"] for r in T.vtc(trials(spark, [0, 0, 0])).orderBy("trial_idx").collect()]
    assert v == [None] * 3
    x = T.vtc(trials(spark, [0, 1.0, 0, 2.0, 0])).orderBy("trial_idx").collect()
    assert [r["rt_filled"] for r in x] == [1.0, 1.0, 1.5, 2.0, 2.0]
    assert [r["VTC"] for r in x] == pytest.approx([1, 1, 0, 1, 1])


def test_zone_ties(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 2.0), ("s", 3.0), ("s", None)], "subject string, VTC double")
    out = {r["VTC"]: r["zone"] for r in T.zone_label(df, "VTC", ["subject"]).collect()}
    closed = {r["VTC"]: r["zone"] for r in T.zone_label(df, "VTC", ["subject"], closed="in").collect()}
    assert out == {1.0: "in", 2.0: "out", 3.0: "out", None: None} and closed[2.0] == "in"


def test_gauss_smooth_reflects(spark):
    x = np.array([1.0, 5.0, 2.0])
    k = T.gauss_kernel()
    idx = [j % 6 if j % 6 < 3 else 5 - j % 6 for j in range(-10, 13)]
    want = [sum(w * x[idx[i + m]] for m, w in enumerate(k)) for i in range(3)]
    got = T.gauss_smooth(trials(spark, x), "reaction_time", ["subject", "run"], "trial_idx").orderBy("trial_idx").collect()
    assert [r["reaction_time_smoothed"] for r in got] == pytest.approx(want)


def test_sliding_windows_shorter_than_window(spark):
    assert T.sliding_trials(T.vtc(trials(spark, [1.0] * 5)), 20, 5).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=23), st.integers(1, 7))
def test_equal_count_bins_are_array_split(spark, xs, k):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    want = [np.mean(a) for a in np.array_split(np.sort(xs), k) if len(a)]
    keyed = X.equal_count_bins(df.withColumn("g", F.lit(1)), "x", k, ["g"], "x", "i").orderBy("bin").collect()
    spread = X.equal_count_bins_global(df, "x", k, "x", "i").orderBy("bin").collect()
    assert [r["x_mean"] for r in keyed] == pytest.approx(want)
    assert [r["x_mean"] for r in spread] == pytest.approx(want)


def test_fdr_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, 0.5), (5, None)], "i int, p double")
    got = {r["i"]: r["p_adj"] for r in X.fdr_bh(df.withColumn("f", F.lit(1)), "p", ["f"]).collect()}
    assert got[5] is None and [got[i] for i in (1, 2, 3, 4)] == pytest.approx([0.08 / 3, 0.08 / 3, 0.08 / 3, 0.5])


def test_intervals_are_closed_and_may_overlap(spark):
    s = spark.createDataFrame([("a", float(t), float(t)) for t in range(6)], "k string, t double, v double")
    b = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.5, 3.0), ("b", 0.0, 9.0)], "k string, t_start double, t_stop double")
    masked = [r["v"] for r in J.mask_intervals(s, b, ["k"]).orderBy("t").collect()]
    assert masked == [0.0, None, None, None, 4.0, 5.0]
    kept = sorted(r["t"] for r in J.keep_in_intervals(s, b, ["k"], 1.0).collect())
    assert kept == [1.0, 2.0, 3.0]


def test_nearest_prefers_earlier(spark):
    a = spark.createDataFrame([("k", 1.0)], "k string, t double")
    b = spark.createDataFrame([("k", 0.0, 10.0), ("k", 2.0, 20.0)], "k string, ts double, v double")
    assert J.asof_nearest(a, b, ["k"], "t", "ts", "v").first()["near_v"] == 10.0
    assert J.asof_nearest(a, b.filter("ts > 5"), ["k"], "t", "ts", "v").first()["near_v"] is None


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(links.limit(0), "a", "b").count() == 0


def test_clusters(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=30)
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, 50.0, 0.0, 0.0)], "vertex long, x double, y double, z double")
    s = spark.createDataFrame([(0, base.tolist()), (1, (base * 2).tolist()), (2, rng.normal(size=30).tolist()), (3, base.tolist())], "vertex long, v array<double>")
    assert sorted((r["vertex"], r["cluster"]) for r in cluster_series(v, s, 5.0, 0.99, 2).collect()) == [(0, 0), (1, 0)]


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=50), rng.normal(size=50)
    y = 1 + 2 * x - z + rng.normal(size=50)
    df = spark.createDataFrame([("g", *map(float, r)) for r in zip(x, z, y, strict=True)], "g string, x double, z double, y double")
    got = R.ols(df, "y", {"const": F.lit(1.0), "x": F.col("x"), "z": F.col("z")}, ["g"]).first()
    a = np.column_stack([np.ones(50), x, z])
    b, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    assert [got["b_const"], got["b_x"], got["b_z"]] == pytest.approx(b) and got["rss"] == pytest.approx(rss[0])


def test_partition_invariance(spark):
    df = trials(spark, list(np.random.default_rng(2).uniform(0.2, 1, 60)))
    a = T.vtc(df).orderBy("trial_idx").collect()
    b = T.vtc(df.repartition(7).orderBy(F.rand(3))).orderBy("trial_idx").collect()
    assert a == b


def test_trial_files_round_trip(spark, tmp_path):
    head = "onset\tduration\tvalue\ttrial_type\texemplar\treaction_time\tresponse_code\tVTC\tVTC_smoothed\n"
    (tmp_path / "sub-7_task-x_run-01_events.tsv").write_text(head + "0.5\t0.8\t1\tcity\t3\t0.41\t1\tnan\t0.2\n1.3\t0.8\t0\tmnt\t1\t0\t0\t0.1\t0.2\n")
    got = IO.read_trials(spark, str(tmp_path / "*.tsv")).orderBy("trial_idx").collect()
    assert [(r["subject"], r["run"], r["trial_idx"], r["VTC"]) for r in got] == [("7", 1, 0, None), ("7", 1, 1, 0.1)]
    IO.write_trials(IO.read_trials(spark, str(tmp_path / "*.tsv")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/parquet")).count() == 2


def test_amplifier_file(spark, tmp_path):
    lines = [f"preamble {i}" for i in range(12)] + ["Time(s),TRIGGER(DIGITAL),CH1,CH2", "0.0,1,5,7", "0.5,0,6,8"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = IO.read_samples_csv(spark, str(tmp_path / "a.csv"), ["Time(s)", "TRIGGER(DIGITAL)", "CH1", "CH2"])
    assert sorted((r["t"], r["trigger"], r["channel"], round(r["v"] * 1e6, 6)) for r in got.collect()) == [(0.0, 1.0, "CH1", 5.0), (0.0, 1.0, "CH2", 7.0), (0.5, 0.0, "CH1", 6.0), (0.5, 0.0, "CH2", 8.0)]


def test_notes_and_gaze(spark, tmp_path):
    notes = spark.createDataFrame([("n", "text\n2024-01-02-10-11-12 watch Run 2\nmore")], "path string, text string")
    assert [tuple(r) for r in IO.parse_folder_notes(notes).collect()] == [("n", "2024-01-02-10-11-12", "watch", 2)]
    (tmp_path / "sub-1_run-2_gaze.tsv").write_text("timestamps\ttimestamps_neon\ttime\teyeleft_pupilDiameter\teyeright_pupilDiameter\n1\t1\t1\t2\t4\n2\t2\t2\tnan\t4\n")
    both = [r["pupil"] for r in IO.read_gaze(spark, str(tmp_path)).orderBy("time").collect()]
    either = [r["pupil"] for r in IO.read_gaze(spark, str(tmp_path), "any").orderBy("time").collect()]
    assert both == [3.0, None] and either == [3.0, 4.0]


def test_results_are_written_in_a_fixed_number_of_folders(spark, tmp_path):
    rows = [(f"s{i}", [1.0, float(i)]) for i in range(50)]
    IO.write_results(spark.createDataFrame(rows, "subject string, beta array<double>"), str(tmp_path / "r"), buckets=4)
    assert len(list((tmp_path / "r").glob("bucket=*"))) == 4
    got = spark.read.parquet(str(tmp_path / "r")).select("subject", "beta").collect()
    assert sorted((r["subject"], r["beta"]) for r in got) == sorted(rows)


def test_materialize_reads_back(spark):
    df = spark.range(5).withColumn("a", F.array(F.col("id")))
    assert materialize(df, "t").orderBy("id").collect() == df.orderBy("id").collect()


def test_neighbours_and_fill_of_one_long_run(spark):
    """A run of 200,000 samples takes seconds; results equal numpy's."""
    import time

    n = 200_000
    rng = np.random.default_rng(4)
    x = spark.range(n).selectExpr("1 as k", "id as i", "case when id % 7 = 3 then cast(id * 37 % 1001 as double) end as x", "id / 4.0d as t")
    began = time.perf_counter()
    filled = np.array([r[0] for r in T.fill(x, "x", ["k"], "i").orderBy("i").select("x_filled").collect()])
    at = np.arange(3, n, 7)
    assert filled == pytest.approx(np.interp(np.arange(n), at, at * 37 % 1001))
    left = spark.createDataFrame([(1, float(t)) for t in rng.uniform(-5, n / 4 + 5, 2000)], "k int, lt double")
    right = x.filter("x is not null")
    ts, vs = at / 4.0, (at * 37 % 1001).astype(float)
    near = J.asof_nearest(left, right, ["k"], "lt", "t", "x").collect()
    for r in near:
        d = np.abs(ts - r["lt"])
        assert r["near_v"] == vs[int(np.argmin(d))]
    lin = J.interp_join(left, right, ["k"], "lt", "t", "x").collect()
    assert [r["interp"] for r in lin] == pytest.approx([float(np.interp(r["lt"], ts, vs)) for r in lin])
    forward = J.asof_forward(left, right, ["k"], "lt", "t", "x").collect()
    for r in forward:
        j = int(np.searchsorted(ts, r["lt"]))
        assert r["next_v"] == (vs[j] if j < len(ts) else None)
    assert time.perf_counter() - began < 60


def test_neighbours_without_times_and_with_ties(spark):
    left = spark.createDataFrame([(1, 2.0), (1, None), (2, 1.0), (None, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 7.0), (1, None, 9.0), (1, 3.0, None)], "k int, ts double, v double")
    got = {(r["k"], r["t"]): (r["near_t"], r["near_v"]) for r in J.asof_nearest(left, right, ["k"], "t", "ts", "v").collect()}
    assert got == {(1, 2.0): (2.0, 7.0), (1, None): (None, None), (2, 1.0): (None, None), (None, 1.0): (None, None)}
