"""Plans and batches whose cost per row stays bounded as tables grow."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import regression as R
from tessera.operators import signals as S
from tessera.operators import trials as T
from tessera.plans.model_queries import Q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hrf_sums_stay_where_they_are_made(spark):
    """The sums per time are not sent again: their two aggregates have no exchange between them."""
    t = spark.createDataFrame([("a", "e", 0.8 * i, 1.0) for i in range(50)], "subject string, event string, onset double, value double")
    times = spark.createDataFrame([("a", i / 2) for i in range(80)], "subject string, t double")
    p = plan(R.hrf_design(t, times, ["subject"])).splitlines()
    at = [i for i, line in enumerate(p) if "HashAggregate" in line]
    assert len(at) == 2 and not any("Exchange" in line for line in p[at[0] : at[1]])
    assert sum("REPARTITION_BY_NUM" in line for line in p) == 2


def test_trial_responses_are_not_grouped_by_trial(spark):
    """A trial meets the response of its subject; nothing is aggregated by trial and time."""
    assert not [line for line in plan(Q["r30_trial_hrf"](spark, SF)).splitlines() if "Aggregate" in line.split("keys=")[0] and "trial_idx" in line.split("keys=")[-1].split("]")[0]]


def test_kernels_take_batches_of_series(spark):
    """No group of its own per run, subject or trial."""
    for name in ("r31_prewhitened_xcorr", "r27_ar_loglik", "g26_pc_scores"):
        assert "FlatMapGroupsInPandas" not in plan(Q[name](spark, SF)), name


def test_products_of_a_batch_leave_it_at_once(spark):
    """A batch of times with missing channels yields one frame, with the sums of the pairs that meet."""
    rng = np.random.default_rng(1)
    rows = [(k, c, i, float(rng.normal())) for k in range(30) for i in range(5) for c in range(3) if (k + i + c) % 4]
    x = spark.createDataFrame(rows, "k int, channel int, i int, x double")
    want = {}
    for k, c, i, v in rows:
        for k2, c2, i2, v2 in rows:
            if (k, i) == (k2, i2):
                want[k, c, c2] = want.get((k, c, c2), 0.0) + v * v2
    got = {(r["k"], r["channel"], r["other"]): r["s"] for r in S.channel_products(x, ["k"]).collect()}
    assert all(abs(got[p] - v) < 1e-9 for p, v in want.items())
    assert all(abs(v) < 1e-12 for p, v in got.items() if p not in want)


def test_sweep_of_a_run_takes_all_widths_at_once():
    """Each width has the difference of its own smoothed values; a run without press times has none."""
    rng = np.random.default_rng(2)
    x, rt = rng.random(90), rng.random(90)
    rt[rng.random(90) < 0.3] = np.nan
    sigmas = tuple(1 + k / 2 for k in range(50))
    got = T._sweep(x, rt, sigmas)
    for s, d in zip(sigmas, got, strict=True):
        k = np.arange(-int(4 * s + 0.5), int(4 * s + 0.5) + 1)
        w = np.exp(-0.5 * (k / s) ** 2)
        at = (np.arange(90)[:, None] + k) % 180
        smooth = x[np.where(at < 90, at, 179 - at)] @ (w / w.sum())
        low, some = smooth < np.median(smooth), ~np.isnan(rt)
        assert abs(d - (rt[low & some].mean() - rt[~low & some].mean())) < 1e-9
    assert T._sweep(x, np.full(90, np.nan), sigmas) == [None] * 50


def test_nested_models_are_solved_once(spark):
    """A filter on the models does not run the solver again, in Python workers of its own."""
    for name in ("r16_nested_designs", "r20_group_tests"):
        steps = [line for line in plan(Q[name](spark, SF)).splitlines() if "EvalPython" in line or "InArrow" in line or "InPandas" in line]
        assert len(steps) == 1, name


def test_solver_of_nested_models_takes_parts_of_a_batch():
    """Ten times the keys of a batch take no more memory, and keys on both sides of a cut have their own fits."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((100_000, 10, 1)), rng.normal(size=(100_000, 10, 4))], axis=2)
    sums = np.einsum("kri,krj->kij", x, x)[:, *np.triu_indices(5)]
    packed = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, 15, dtype=np.int32), sums.ravel())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(100_000)), pa.array(np.full(100_000, 10)), packed], ["key", "n", "__m"])
    chosen = [(), ("s",), ("e",), ("s", "e")]
    solve = R._nested_solver(5, [0, 1], {"s": [2], "e": [3]}, chosen, [(("s", "e"), ("e",))])
    peak, rss = {}, {}
    for keys in (10_000, 100_000):
        tracemalloc.start()
        for part in solve([batch.slice(0, keys)]):
            rss |= {k: part.column("__rss")[i].as_py() for i, k in enumerate(part.column("key").to_pylist()) if k % 4_999 < 2}
        peak[keys] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak[100_000] < 1.2 * peak[10_000]
    assert len(rss) == 42
    for k, found in rss.items():
        for at, got in zip(([0, 1], [0, 1, 2], [0, 1, 3], [0, 1, 2, 3]), found, strict=True):
            assert got == pytest.approx(np.linalg.lstsq(x[k][:, at], x[k, :, 4], rcond=None)[1][0])
