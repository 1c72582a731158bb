"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

EDGES_PER_TASK = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (id, component): every id that has an edge to another, and the smallest id it reaches.

    Large-star and small-star steps in turn: each step is a minimum per node (combined before the
    shuffle, so that a hub with a third of all edges costs no more than any other) and a join of that
    minimum back to the edges, which adaptive execution may split. Rows stay in the order of the edges:
    a step never makes more edges than it was given. Rounds grow with the logarithm of the longest
    path. Self edges, null ends and repeated edges have no effect; no edges give no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    digest = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    state = tuple(e.agg(*digest).first())
    n = max(1, -(-state[0] // EDGES_PER_TASK))  # few edges don't need many tasks; a round never makes more of them
    kept = lambda low: low.hint("merge") if n > 1 else low  # noqa: E731  # many minima don't go to the driver, however small their file
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(n)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(kept(low), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.coalesce(n).distinct().coalesce(n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(kept(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(n).distinct().coalesce(n))
        before, state = state, tuple(e.agg(*digest).first())
        if state == before:
            break
    else:
        raise RuntimeError("the components have not settled")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
