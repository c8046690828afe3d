"""Connected components by alternating large-star and small-star steps; no step gathers a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b) with a > b. Each node links its larger (large star) or smaller (small star) neighbours to its least one."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if small:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a long, b long), in any order, repeats and loops allowed -> (node, root): root is the least node of its component.

    Nodes without a link to another node are left out. Null ends: the link is dropped. No links: no rows.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        edges = stage(_star(_star(edges, False), True), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
