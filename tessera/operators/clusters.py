"""Clusters of spatial series by distance and correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components


#: Vertices of a block at most, about, and rows of one block that meet another block at a time.
BLOCK, STRIP = 8192, 256


def _blocks(vertices: DataFrame, series: DataFrame, radius: float, size: int) -> DataFrame:
    """Vertices with their series and the pair of blocks (lo, hi) in which they meet others, once for every pair.

    A block is a part of a cubic cell of one length of series; it meets the parts of the 27 cells around it.
    """
    cell = [F.floor(F.col(c) / radius).cast("int").alias(f"c{i}") for i, c in enumerate("xyz")]
    points = vertices.select("vertex", *cell, F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("at")).dropna()
    points = points.join(series.select("vertex", "v").filter("v is not null"), "vertex").withColumn("len", F.size("v"))
    key = ["len", "c0", "c1", "c2"]
    parts = points.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("parts"))
    points = points.join(parts, key).withColumn("block", F.struct(*key, F.pmod(F.xxhash64("vertex"), "parts").alias("part")))
    blocks = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*key, F.struct(*key, "part").alias("block"))
    near = blocks.withColumnRenamed("block", "other")
    for i in range(3):
        near = near.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + k for k in (-1, 0, 1)])))
    meets = blocks.join(near, key).select("block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return points.drop(*key, "parts").join(meets, "block").select("lo", "hi", (F.col("block") == F.col("lo")).alias("first"), "vertex", "at", "v")


def near_and_correlated(vertices: DataFrame, series: DataFrame, radius: float, tau: float, size: int = BLOCK) -> DataFrame:
    """Links (a, b) with the components of all pairs of vertices within the radius whose series correlate at `tau` or more.

    Pairs are never rows. Two blocks meet in one task as a product of matrices, strip by strip, and leave a star for every
    component of their links: one row at most per vertex and pair of blocks.
    """

    def stars(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["first", "vertex"], ascending=[False, True], ignore_index=True)
        at = np.array(p["at"].tolist(), dtype=float).reshape(len(p), 3)
        v = np.array(p["v"].tolist(), dtype=float).reshape(len(p), -1)
        v = v - v.mean(axis=1, keepdims=True) if v.shape[1] else v
        with np.errstate(all="ignore"):
            v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        mine = int(p["first"].sum())
        other = mine if mine < len(p) else 0
        root = np.arange(len(p))
        for k in range(0, mine, STRIP):
            i, j = np.nonzero(v[k : min(k + STRIP, mine)] @ v[other:].T >= tau)
            i, j = i + k, j + other
            ok = (i != j) & (np.sqrt(((at[i] - at[j]) ** 2).sum(axis=1)) <= radius)
            i, j = i[ok], j[ok]
            while len(i):
                x, y = root[i], root[j]
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(root, up := root[root]):
                    root = up
        linked = root != np.arange(len(p))
        return pd.DataFrame({"a": p["vertex"][root[linked]].to_numpy(), "b": p["vertex"][linked].to_numpy()})

    kind = vertices.schema["vertex"].dataType.simpleString()
    return _blocks(vertices, series, radius, size).groupBy("lo", "hi").applyInPandas(stars, f"a {kind}, b {kind}")


def cluster_series(vertices: DataFrame, series: DataFrame, radius: float, tau: float, min_size: int) -> DataFrame:
    """(vertex, cluster): components of near and correlated vertices, small ones dropped."""
    links = near_and_correlated(vertices, series, radius, tau)
    c = connected_components(links, "a", "b").withColumnRenamed("node", "vertex").withColumnRenamed("component", "cluster")
    big = c.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("cluster")
    return c.join(big, "cluster", "left_semi").select("vertex", "cluster")


def roi_correlations(df: DataFrame) -> DataFrame:
    """(a, b, r) of every pair of regions from (roi, t, v), a < b (C2); there are a few hundred regions, and pairs meet on time."""
    b = df.select(F.col("roi").alias("b"), "t", F.col("v").alias("y"))
    return df.join(b, "t").filter(F.col("roi") < F.col("b")).groupBy(F.col("roi").alias("a"), "b").agg(F.corr("v", "y").alias("r"))


def correlation_groups(df: DataFrame, tau: float = 0.9) -> DataFrame:
    """(roi, group): components of regions correlated at `tau` or more."""
    c = connected_components(roi_correlations(df).filter(F.col("r") >= tau), "a", "b")
    return c.select(F.col("node").alias("roi"), F.col("component").alias("group"))
