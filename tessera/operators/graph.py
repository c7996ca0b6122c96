"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import discard, materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction step over edges (u, v) with u > v.

    Large star: every larger neighbour of a node is linked to the smallest node around it.
    Small star: every smaller neighbour of a node, and the node, are linked to the smallest of them.
    """
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component), component = smallest node.

    Nodes are comparable values of one type. Self links and repeated links are allowed; rows with a
    null end are ignored; a node without links does not appear. Alternating star contraction needs
    O(log^2 n) rounds, keeps one row per node and link, and leaves nothing on the driver but a
    checksum. Each round is a table in shared storage, so lineage stays short.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v and v is not null").distinct(),
        "edges",
    )
    sign = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    before = edges.agg(*sign).first()
    for _ in range(max_rounds):
        if not before[0]:
            break
        after = materialize(_stars(_stars(edges, small=False), small=True), "edges")
        discard(edges)
        edges = after
        now = edges.agg(*sign).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
