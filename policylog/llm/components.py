"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylog.llm.common import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for each node of edges (u, v: long); root is the smallest node that can be reached.

    Nulls and loops are ignored, repeats allowed. Every round groups with map-side combining and joins on the
    node, so a hub's rows can be split by the adaptive skew join; each round is cut by a reliable checkpoint.
    """
    stars = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = settle(stars)
    state = _state(stars)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "at")
        large = both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = large.join(low, F.col("u") == F.col("at")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = settle(small.unionByName(low.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct())
        if (now := _state(stars)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
