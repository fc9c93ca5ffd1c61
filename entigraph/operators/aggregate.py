"""Counting, grouping and ranking; results of queries are sets, so entities are counted once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_by(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("id").alias("n"))


def _valued(rows: DataFrame, slot: str) -> DataFrame:
    value = F.explode(F.array_distinct(slot)) if rows.schema[slot].dataType.typeName() == "array" else F.col(slot)
    return rows.select("id", value.alias("value")).where("value is not null")


def group_by(rows: DataFrame, slot: str) -> DataFrame:
    """(value, n): entities per value of a slot; unset ones are left out, one with several values counts for each."""
    return _valued(rows, slot).groupBy("value").agg(F.countDistinct("id").alias("n"))


def group_total(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def degree(ids: DataFrame, edges: DataFrame, direction: str = "both", predicates: Iterable[str] | None = None) -> DataFrame:
    """(id, score) for every id, 0 without edges. direction: forward, inverse or both; a self-loop counts out and in."""
    if predicates is not None:
        edges = edges.where(F.col("predicate").isin(list(predicates)))
    end = {"forward": F.col("src"), "inverse": F.col("dst"), "both": F.explode(F.array("src", "dst"))}[direction]
    score = edges.select(end.alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.select("id").join(score, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("score"))


def backlink_density(ids: DataFrame, edges: DataFrame, predicates: Iterable[str] | None = None) -> DataFrame:
    return degree(ids, edges, "inverse", predicates)


def top_k(rows: DataFrame, k: int, *keys) -> DataFrame:
    """The first k rows by keys, ties by id; 0: all."""
    rows = rows.orderBy(*keys, "id")
    return rows.limit(k) if k else rows


def top_k_counts(rows: DataFrame, k: int) -> DataFrame:
    """(total, returned) of top_k."""
    n = rows.agg(F.count("*").alias("total"))
    return n.select("total", F.least("total", F.lit(k)).alias("returned") if k else F.col("total").alias("returned"))


def rank_by(rows: DataFrame, by: str, edges: DataFrame | None = None, slot: str | None = None, limit: int = 20, **more) -> DataFrame:
    """by: degree, backlink_density (over edges; unlinked entities stay, at 0), recency or freshness (by a temporal slot; unset ones go)."""
    if by in ("degree", "backlink_density"):
        scored = degree(rows, edges, "inverse" if by == "backlink_density" else more.pop("direction", "both"), **more)
        return top_k(scored, limit, F.desc("score"))
    if by not in ("recency", "freshness"):
        raise ValueError(f"no rank named {by}")
    values = _valued(rows, slot)
    values = values.groupBy("id").agg((F.max if by == "recency" else F.min)("value").alias("value"))
    return top_k(values, limit, F.desc("value") if by == "recency" else F.asc("value"))


def rank_within(scored: DataFrame, group: str, limit: int) -> DataFrame:
    """The first `limit` rows of each group by score, ties by id, with their rank. Candidates are cut in each task first, so a hot group is not sorted whole."""
    order = [F.desc("score"), F.asc("id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= limit)


def facets(rows: DataFrame, slots: Iterable[str]) -> DataFrame:
    """(slot, value, n) for several slots in one pass; nulls are left out."""
    each = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).cast("string").alias("value")) for s in slots])
    return rows.select("id", F.explode(each).alias("f")).where("f.value is not null").groupBy("f.slot", "f.value").agg(F.countDistinct("id").alias("n"))


def by_class_and_name(rows: DataFrame) -> DataFrame:
    return rows.orderBy("class", "ident", "id")
