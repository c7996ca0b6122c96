"""Registered queries without SQL cover their whole tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.plans.model_queries import EP, FS, Q
from tessera.plans.views import v_epochs

SF = "/root/testdata/sf0.1"


def test_bspline_compress_uses_all_samples(spark):
    d = "/root/testdata/sf0.001"
    got = {(*(r[k] for k in EP), r["spline"]): r["x"] for r in Q["r15_bspline_compress"](spark, d).collect()}
    b = K.bspline(64, 6)
    for r in v_epochs(spark, d).collect():
        want = np.asarray(r["v"], float) @ b
        assert [got[(*(r[k] for k in EP), s)] for s in range(6)] == pytest.approx(want.tolist(), abs=2e-5)


def test_band_power_at_covers_all_trials(spark):
    got = Q["g14_band_power_at"](spark, SF)
    epochs = v_epochs(spark, SF)
    assert epochs.filter("trial_idx >= 200").count() > 0
    assert got.count() == 4 * epochs.count()
    last = epochs.orderBy(F.desc("trial_idx"), "channel").first()
    p = K.butter_filtfilt(np.asarray(last["v"], float), FS, 8.0, 12.0) ** 2
    rows = got.filter(" and ".join(f"{k} = {last[k]}" for k in EP)).collect()
    assert {r["sample"]: r["power"] for r in rows} == pytest.approx({i: float(np.median(p[max(0, i - 8) : i + 9])) for i in (8, 24, 40, 56)}, abs=2e-8)
