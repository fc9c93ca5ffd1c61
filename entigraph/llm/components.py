"""Connected components by alternating large-star and small-star rounds, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entigraph.llm.common import stored

MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over distinct (u, v), u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge, itself the root or not; root: the smallest node reachable.

    edges: (u, v) of any orderable type, either way round, repeats, self-links and nulls allowed (nulls and self-links say nothing).
    Each round is written to the shared folder. A hub is the key of a join, which Spark splits when skewed; no group is gathered.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        if mark[0]:
            now = stored(_stars(now), "cc")
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
