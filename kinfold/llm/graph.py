"""Connected components by alternating large-star and small-star steps.

Rows are pairs of ids throughout; what a star's centre needs of its rows, their minimum, is aggregated before it moves.
The rows of a large star meet that minimum in a join by their centre, which adaptive execution splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of every id in `edges` (a, b), the smallest id it is linked with, over any number of links.

    Self-links are ignored, repeated links are fine; ids that occur only in self-links are not returned. An empty
    table gives an empty result. Each round ends in a checkpoint, so lost executors cost one round at most.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e, before = cut(e), None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
