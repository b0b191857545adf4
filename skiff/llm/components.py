"""Connected components by alternating large and small stars on a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import dropped, kept


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, under
    their least; the edges stay in the shared folder, never on the driver.  Least
    neighbours come from a partial aggregate, so a node of many edges isn't one task."""
    now = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = _print(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("x"), "m").filter("x <> m").unionAll(lower.select(F.col("a").alias("x"), "m"))
        now, old = kept(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges"), now
        dropped(old)
        after = _print(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = now.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
