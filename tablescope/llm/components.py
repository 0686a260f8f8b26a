"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, stored


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node; written, so that the join back can split hubs."""
    return stored(pairs.groupBy("a").agg(F.min("b").alias("low")), "component-least")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    found = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
    return found, least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    found = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
    return found.select("e.*").filter("a != b"), least


def components(edges: DataFrame) -> DataFrame:
    """Label every node of edges (a, b) with the smallest node of its component.

    Alternates large-star and small-star steps; both are an aggregate and a
    join, written to the shared folder.  Returns a (node) and b (label) for
    nodes other than the label itself.  No edges give no rows.
    """
    state = stored(edges.filter("a != b").select("a", "b").distinct(), "component-edges")
    seen = None
    while True:
        sign = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign == seen or not sign.n:
            return state
        seen = sign
        wide, first = _large_star(state)
        wide = stored(wide.distinct(), "component-edges")
        narrow, second = _small_star(wide)
        after = stored(narrow.distinct(), "component-edges")
        discard(state, first, wide, second)
        state = after
