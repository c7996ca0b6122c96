"""Written sources are packed: their files don't grow with recordings, subjects or trials."""

from __future__ import annotations

from pathlib import Path

import pytest

from tessera.plans import source_queries as Q
from tessera.sources import tables as IO

SF = "/root/testdata/sf0.01"
NAMES = "s1_read_trials s2_read_gaze s6_write_trials p19_parse_folder_notes s3_read_samples_csv".split()


@pytest.mark.parametrize("name", NAMES)
def test_files_do_not_grow_with_subjects(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(Q, "_folder", lambda spark, n: str(tmp_path / n))
    assert Q.Q[name](spark, SF).count() > 0
    files = [p for p in Path(tmp_path).rglob("part-*") if p.suffix != ".crc"]
    assert 0 < len(files) <= IO.BUCKETS + 8


def test_packed_recordings_read_as_single_ones(spark, tmp_path):
    rows = [(s, r, 2.0 * i, 0.8, 1, "city", 1, 0.5 + i, 1, None, None) for s in ("a", "b") for r in (1, 12) for i in range(3)]
    t = spark.createDataFrame(rows, f"subject string, run int, {IO.TRIALS}")
    for packed in (False, True):
        IO.write_trials(t, str(tmp_path / str(packed)), packed)
    one, many = (sorted(map(tuple, IO.read_trials(spark, p, k).select("subject", "run", "trial_idx", "onset", "reaction_time", "VTC").collect())) for p, k in ((f"{tmp_path}/False/tsv", False), (f"{tmp_path}/True/tsv", True)))
    assert one == many and len(one) == 12
