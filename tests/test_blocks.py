"""Clusters from blocks of vertices: no pair is a row, and none is lost."""

from __future__ import annotations

import numpy as np

from tessera.operators import clusters as C


def test_components_of_all_pairs_from_small_blocks(spark):
    rng = np.random.default_rng(4)
    at, v = rng.normal(0, 6, (300, 3)), rng.normal(0, 1, (300, 24))
    v[7], v[8] = 1.0, v[9]
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "vertex long, x double, y double, z double")
    series = spark.createDataFrame([(i, x[: 23 if i % 50 == 3 else 24].tolist()) for i, x in enumerate(v)], "vertex long, v array<double>")
    group = list(range(300))
    for i in range(300):
        for j in range(i):
            if np.linalg.norm(at[i] - at[j]) <= 8 and (i % 50 == 3) == (j % 50 == 3) and 7 not in (i, j):
                n = 23 if i % 50 == 3 else 24
                if np.corrcoef(v[i, :n], v[j, :n])[0, 1] >= 0.45:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
    want = sorted((i, g) for i, g in enumerate(group) if group.count(g) > 1)
    links = C.near_and_correlated(vertices, series, 8.0, 0.45, size=10)
    got = C.connected_components(links, "a", "b").collect()
    assert sorted((r["node"], r["component"]) for r in got) == want
    assert len({g for _, g in want}) > 1


def test_links_are_at_most_a_row_per_vertex_and_pair_of_blocks(spark):
    vertices = spark.range(200).selectExpr("id as vertex", "0.5d as x", "0.5d as y", "0.5d as z")
    series = spark.range(200).selectExpr("id as vertex", "array(1d, 2d, 4d) as v")
    assert C.near_and_correlated(vertices, series, 8.0, 0.3).count() == 199
