"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made since each open `cleared` block began.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local master gets a new local folder, and a cluster an error: its executors would write to disks of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(at)
    return at


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written and read again: cuts its lineage, survives lost executors, and gives joins true sizes. The table stays until the session's user removes it (see cleared)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df stored in as many buckets by keys as there are shuffle partitions: a join or distinct by these keys moves none of its rows again. It is a table of the session's catalog, under a
    name of its own, until the session or a `cleared` block ends."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(table)
    for made in _OPEN:
        made.append(f"table:{table}")
    return spark.table(table)


def is_open() -> bool:
    """Whether what is made now is removed at the end of a `cleared` block."""
    return bool(_OPEN)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that calls within it stored. Results made inside must have been written elsewhere, or read, by then: they are plans over these tables."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for at in made:
            if at.startswith("table:"):
                spark.sql(f"drop table if exists `{at[6:]}`")
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
