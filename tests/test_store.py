"""Stores of buckets."""

import os

from entigraph.sources import entities, store


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_updates_touch_their_buckets_only(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    base = spark.createDataFrame([(str(i), i, [f"t{i}"]) for i in range(200)], "id string, n long, tags array<string>")
    store.write_store(base, at, 16)
    assert rows(store.read_store(spark, at)) == rows(base)
    before = files(f"{tmp_path}/s")
    updates = spark.createDataFrame([("5", ["new"]), ("x", ["y"])], "id string, tags array<string>")
    touched = store.upsert_store(spark, at, updates, additive=True)
    assert 1 <= len(touched) <= 2
    want = entities.upsert_slots(base, updates, additive=True)
    assert rows(store.read_store(spark, at)) == rows(want)
    after = files(f"{tmp_path}/s")
    same = {f for f, t in before.items() if after.get(f) == t}
    assert {f for f in before if not any(f"_bucket={b}/" in f for b in touched)} == same  # bytes written grow with the update
    gone = spark.createDataFrame([("7",), ("none",)], "id string")
    store.retract_store(spark, at, gone)
    assert rows(store.read_store(spark, at)) == rows(entities.retract(want, gone))
    assert store.upsert_store(spark, at, updates.limit(0)) == [] and store.retract_store(spark, at, gone.limit(0)) == []


def test_a_bucket_can_end_empty(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    store.write_store(base, at, 64)
    store.retract_store(spark, at, spark.createDataFrame([("a",)], "id string"))
    assert rows(store.read_store(spark, at)) == rows(base.where("n > 1"))
    store.upsert_store(spark, at, spark.createDataFrame([("a", 9)], "id string, n int"))
    assert rows(store.read_store(spark, at)) == [("a", 9), ("b", 2), (None, 3)] or len(rows(store.read_store(spark, at))) == 3
