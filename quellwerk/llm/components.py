"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.llm.common import materialise, temporary


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Connects every node's larger (or smaller) neighbours to its smallest neighbour or itself.

    The minimum is combined on the map side and then joined back, so the neighbours of a hub are
    never gathered; a hub's rows may be split by the adaptive skew join."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
    joined = both.join(least, "n")
    moved = joined.filter("m > n") if large else joined
    out = moved.select(F.col("m").alias("u"), F.col("least").alias("v"))
    if not large:
        out = out.union(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v), component being its smallest node.

    Each round is cut from its lineage by a written table. Rounds grow with the logarithm of the
    longest path; when a round changes nothing, every component is a star around its smallest."""
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        with temporary(edges.sparkSession, now):
            now = materialise(_stars(_stars(now, large=True), large=False), "edges", outlive=True)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
