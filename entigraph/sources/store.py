"""Entities in a folder of buckets by id: an update reads and writes the buckets that its ids are in, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.scratch import stored
from entigraph.sources.entities import retract, upsert_slots

BUCKET = "_bucket"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """rows (id, ...) as a new store at path. The number of buckets is kept with it: as many as a part of an update should be of the whole."""
    rows.withColumn(BUCKET, _bucket(buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/meta")


def _columns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark, path).drop(BUCKET)


def _rewrite(spark: SparkSession, path: str, changed: DataFrame, change) -> list[int]:
    """change(rows of the buckets that changed (id) is in), put in these buckets' place; their numbers."""
    buckets = spark.read.parquet(f"{path}/meta").first().buckets
    touched = sorted(r[0] for r in changed.select(_bucket(buckets).alias(BUCKET)).distinct().collect())  # no more than there are buckets
    if not touched:
        return []
    # stored first, so that what is read is not what is overwritten, and a lost task can be run again
    new = stored(change(_columns(spark, path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)).withColumn(BUCKET, _bucket(buckets)), "store")
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/rows")
    left = {r[0] for r in new.select(BUCKET).distinct().collect()}
    for b in set(touched) - left:  # nothing was written there, so nothing was overwritten
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{BUCKET}={b}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return touched


def upsert_store(spark: SparkSession, path: str, updates: DataFrame, additive: bool = False) -> list[int]:
    """upsert_slots() over the store at path; the buckets that were written."""
    return _rewrite(spark, path, updates, lambda rows: upsert_slots(rows, updates, additive))


def retract_store(spark: SparkSession, path: str, ids: DataFrame) -> list[int]:
    """retract() over the store at path; the buckets that were written."""
    return _rewrite(spark, path, ids, lambda rows: retract(rows, ids))
