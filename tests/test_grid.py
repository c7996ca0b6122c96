"""Values that are equal but for the noise of sums: zones, ratios and rounded means agree with their SQL on mirrored and shared values."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import trials as T
from tessera.plans.aggregate_queries import Q as AQ
from tessera.plans.numeric_sql import SQL as NSQL
from tessera.plans.trial_queries import Q, SQL
from tests.oracle import assert_same

ZONES = "a1_zone_confusion a2_zone_error_rates a30_zone_share a32_zone_rt_diff a3_zone_rt_stats a4_pre_outcome_rt p13_log_power w6_zone_label w6b_zone_closed_in w6c_zone_two_quantiles w6d_zone_by_pupil a5_signal_detection".split()


@pytest.fixture(scope="module")
def mirrored(tmp_path_factory):
    """Users whose values lie at equal distances on both sides of their mean, each many times, in any order."""
    d, rng, rows = tmp_path_factory.mktemp("mirrored"), random.Random(3), []
    start = dt.datetime(2024, 1, 1)
    for user in range(60):
        centre = rng.randrange(1000, 9000)
        for run in (0, 1):
            steps = [s for s in rng.choices(range(1, 60), k=40 + user % 3) for s in (s, -s)] + [0]
            rng.shuffle(steps)
            for i, s in enumerate(steps):
                rows.append((len(rows) * 2 + run, start + dt.timedelta(hours=3 * i + run, seconds=user), user, rng.choice(["view", "view", "purchase", "error", "click"]), (centre + s) / 100, f'{{"k": {rng.randrange(1, 10) if rng.random() < 0.9 else 0}}}'))
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    kinds = [pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64(), pa.string()]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names), f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ZONES)
def test_zones_agree_on_mirrored_values(spark, mirrored, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{mirrored}/events.parquet'")
    assert_same(spark, con, *((Q | AQ)[name], (SQL | NSQL)[name]), mirrored)


def test_noise_does_not_part_equal_deviations(spark):
    """Two runs of one spread whose deviations end in other bits."""
    rows = [(x, i) for i, x in enumerate([1.0, 1.0 + 2**-52, 1.0 + 2**-52])]
    v = spark.createDataFrame([("s", *r) for r in rows], "subject string, VTC double, i int")
    assert [r["zone"] for r in T.zone_label(v, "VTC", ["subject"]).collect()] == ["out"] * 3
    assert [r["zone"] for r in T.zone_label(v, "VTC", ["subject"], closed="in").collect()] == ["in"] * 3


def test_shared_samples_have_one_mean(spark):
    """The same samples in another order: both means lie on the median, so neither is below it."""
    values = [0.1, 0.2, 0.3, 0.7, 1e3]
    samples = [(f"{c}", float(i), x) for c in "ab" for i, x in enumerate(values if c == "a" else values[::-1])]
    trials = [(c, i, 0.0) for i, c in enumerate("ab")]
    s = spark.createDataFrame([("u", t + (10 if k == "b" else 0), v) for k, t, v in samples], "subject string, t double, v double")
    t = spark.createDataFrame([("u", i, 10.0 * i) for _, i, _ in trials], "subject string, trial_idx int, onset double")
    got = T.zone_by_window_mean(t, s.coalesce(1).sortWithinPartitions("t"), ["subject"], 0.0, 5.0, 2, ["subject"]).collect()
    assert [r["zone"] for r in got] == ["out", "out"]


def test_zones_do_not_depend_on_the_order_of_sums(spark, tmp_path):
    """The same press times in reverse order: each keeps its deviation to the bit, in the query and in its SQL."""
    import duckdb

    from tessera.plans.trial_queries import ZONED, v_zoned
    from tessera.plans.views import V_TRIALS

    rng = random.Random(5)
    values = [rng.randrange(1, 50_000) / 100 for _ in range(400)]
    start, found = dt.datetime(2024, 1, 1), []
    for name, order in (("a", values), ("b", values[::-1])):
        d = tmp_path / name
        d.mkdir()
        n = len(order)
        columns = {"event_id": [2 * i for i in range(n)], "ts": [start + dt.timedelta(hours=i) for i in range(n)], "user_id": [1] * n, "event_type": ["view"] * n, "value": order, "props": ['{"k": 1}'] * n}
        pq.write_table(pa.table(columns), f"{d}/events.parquet")
        con = duckdb.connect()
        con.sql(f"create view events as select * from '{d}/events.parquet'")
        found.append({r["reaction_time"]: r["VTC"] for r in v_zoned(spark, str(d)).collect()})
        found.append(dict(con.sql(f"with {V_TRIALS}{ZONED} select reaction_time, vtc from zo").fetchall()))
    assert found[0] == found[1] == found[2] == found[3]
