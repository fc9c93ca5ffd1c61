"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.scratch import new_path, shared_dir, stored

__all__ = ["LOWER", "UPPER", "Recent", "ascii_lower", "map_rows", "new_path", "row_key", "shared_dir", "stored", "table", "unused"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else (unlike lower())."""
    return F.translate(c, UPPER, LOWER)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with state made once per task: make() returns what maps a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name beginning like this that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(text: Column) -> Column:
    """Tells rows with the same doc_id apart: with doc_id, the key by which row-wise results are joined back."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


class Recent(dict):
    """A table of at most 2 * limit entries that keeps what was used lately: a full young table becomes the old one, and hits in that move back."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: not known
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
