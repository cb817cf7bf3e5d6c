"""Connected components of a graph given by its edges, by alternating large and small stars. The star of a node with a large share of all edges is spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

MAX_ROUNDS = 50


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v in, the same after one star operation out. Every node hands its larger (or smaller) neighbours to the least node it knows."""
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = stored(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    joined = spread_join(near, least.select("u", "m"), "u", least.select("u", "n"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that it reaches. Nodes that are their own root are left out."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = stored(_stars(stored(_stars(edges, large=True), "edges"), large=False), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (now["n"], now["h"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (now["n"], now["h"])
    raise RuntimeError(f"components: no end after {MAX_ROUNDS} rounds")
