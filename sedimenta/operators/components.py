"""Connected components of an edge table, by repeated grouping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.sources.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "components", rounds: int = 1000) -> DataFrame:
    """(node, component) for each end of an edge (a, b); component is the least node that can be reached.

    Every round hangs each node's larger neighbours on its least one, then each node's smaller neighbours on the
    least of them (large star, small star), until the edges stay as they are. Both steps are a min per node, combined before
    the shuffle, and an equi-join that Spark may split where a node has very many neighbours. Loops, repeated edges
    and an empty table are allowed; null ends are left out. The number of rounds follows the logarithm of the largest component's
    diameter, squared; should `rounds` not do, an error is raised, as labels that aren't settled would be wrong.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.keep(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{label}/0")
    before = None
    for k in range(1, rounds):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        large = large.unionByName(now.join(least, "a").select(a, F.col("m").alias("b")).where(a != b)).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(b.alias("a"), F.col("m").alias("b")).where(a != b).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        then = scratch.keep(small, f"{label}/{k}")
        state = then.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.count_distinct("a").alias("d")).first()
        scratch.drop(f"{label}/{k - 1}")
        now = then
        if state == before or (state["n"] == state["d"] and _flat(now)):
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(a.alias("node"), b.alias("component")).unionByName(now.select(b.alias("node"), b.alias("component")).distinct())


def _flat(edges: DataFrame) -> bool:
    """Whether no root is itself a child."""
    return edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi").isEmpty()
