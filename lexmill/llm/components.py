"""Connected components of an edge table by alternating stars.

Each round connects all neighbours of a node to the smallest of them: first the larger
neighbours (large star), then the smaller ones (small star). The rounds end when the
edges no longer change; then every node points at the smallest node of its component.
Minima are combined before the shuffle, and the join that hands a hub its minimum is a
plain equi-join that Spark may split. Rounds are written tables, so a lost executor
costs one round at most. Only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(low, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns ``a`` and ``b``, bigint).

    ``root`` is the smallest node of the component. Loops, repeated edges and either
    direction are fine; edges with a null end are ignored. Empty in, empty out.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    state = None
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        now = materialize(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
