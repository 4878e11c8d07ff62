"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.lineage import Rounds, delete, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`edges` (a long, b long) -> (node, component): the smallest node that each node can reach.

    Every round is written to shared storage and takes the one before away; a hub's edges are
    aggregated on the map side and its join is one that adaptive execution can split. Nodes without
    an edge do not appear; no edges give no rows. Raises if `rounds` rounds do not suffice (they
    halve the depth each).
    """
    spark, scratch = edges.sparkSession, []

    def towards_minimum(pairs: DataFrame) -> DataFrame:
        """(u, v) -> (u, v, m), m the least of u and all its v; written first, so a hub's join can be split."""
        least, path = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        scratch.append(path)
        return pairs.join(least, "u")

    state = Rounds(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        e = state.now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = towards_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = towards_minimum(large)
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state.step(small)
        while scratch:
            delete(spark, scratch.pop())
        now = state.now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            e = state.now
            return e.select("u", "v").union(e.select(F.col("v").alias("u"), "v")).distinct().toDF("node", "component")
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")
