"""Differences and patches of nested tables."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from entigraph.operators import changes

SCHEMA = "id string, n long, place struct<city:string,at:struct<x:int,y:double>>, tags map<string,int>, by_day map<date,array<string>>, lines array<struct<sku:string,price:decimal(9,2),more:map<string,string>>>, raw binary, `a.b` string"
DAY = datetime.date(2020, 1, 1)


def rows(df):
    """Maps as sorted items, so that rows can be compared."""
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, (list, tuple)) else ("map", tuple(sorted((str(k), plain(x)) for k, x in v.items()))) if isinstance(v, dict) else bytes(v) if isinstance(v, bytearray) else v
    return sorted((plain(tuple(r)) for r in df.collect()), key=repr)


def made(r, i):
    pick = lambda f: None if r.random() < 0.2 else f()
    word = lambda: r.choice(["", "a", 'q"u[o].t`e', "é\n", "null", "b c"])
    place = pick(lambda: (pick(word), pick(lambda: (pick(lambda: r.randrange(3)), pick(lambda: r.choice([0.5, float("inf"), -2.25]))))))
    tags = pick(lambda: {word(): pick(lambda: r.randrange(3)) for _ in range(r.randrange(4))})
    days = pick(lambda: {DAY + datetime.timedelta(r.randrange(3)): pick(lambda: [pick(word) for _ in range(r.randrange(3))]) for _ in range(r.randrange(3))})
    line = lambda: (pick(word), pick(lambda: Decimal(r.randrange(300)) / 100), pick(lambda: {word(): pick(word) for _ in range(r.randrange(3))}))
    return (i, pick(lambda: r.randrange(3)), place, tags, days, pick(lambda: [pick(line) for _ in range(r.randrange(4))]), pick(lambda: r.choice([b"", b"\xff\x00", b"a"])), pick(word))


@pytest.mark.parametrize("seed", range(1))
def test_patch_of_a_diff_is_the_new_table(spark, seed):
    r = random.Random(seed)
    a = spark.createDataFrame([made(r, f"r{i}") for i in range(0, 60)], SCHEMA)
    b = spark.createDataFrame([made(r, f"r{i}") for i in range(20, 80)], SCHEMA)
    d = changes.diff_snapshots(a, b)
    assert rows(changes.patch(a, d)) == rows(b) and rows(changes.patch(a, d, checked=False)) == rows(b)
    assert rows(changes.patch(b, changes.diff_snapshots(b, a))) == rows(a)
    with pytest.raises(ValueError, match="not as the diff has them"):
        changes.patch(b, d)


def test_paths_and_ops(spark):
    s = "id string, d struct<D1:int,D2:string>, m map<string,map<string,int>>, l array<struct<v:int>>"
    a = spark.createDataFrame([("x", (1, "2"), {"k": {"p": 1, "q": 2}, "gone": {}}, [(1,), (2,), (3,)]), ("old", None, None, [])], s)
    b = spark.createDataFrame([("x", (1, "3"), {"new": {"z": 1}, "k": {"q": 3, "r": 4}}, [(1,), (5,)]), ("new", (7, None), {"m": {}}, None)], s)
    got = {(x.id, x.op, x.path): (x.old_value, x.new_value) for x in changes.diff_snapshots(a, b).collect()}
    assert got == {
        ("x", "*", "d.D2"): ("2", "3"), ("x", "-", 'm["gone"]'): ("{}", None), ("x", "+", 'm["new"]'): (None, '{"z":"1"}'), ("x", "*", 'm["k"]["q"]'): ("2", "3"), ("x", "-", 'm["k"]["p"]'): ("1", None),
        ("x", "+", 'm["k"]["r"]'): (None, "4"), ("x", "*", "l[1].v"): ("2", "5"), ("x", "-", "l[2]"): ('{"v":"3"}', None),
        ("old", "-", "d"): (None, None), ("old", "-", "m"): (None, None), ("old", "-", "l"): ("[]", None), ("new", "+", "d.D1"): (None, "7"), ("new", "+", "d.D2"): (None, None), ("new", "+", "m"): (None, '{"m":{}}'), ("new", "+", "l"): (None, None),
    }


def test_order_of_a_map_is_no_change(spark):
    one = spark.range(1).select(F.lit("r").alias("id"), F.create_map(F.lit("k"), F.lit(1), F.lit("m"), F.lit(2)).alias("m"))
    two = spark.range(1).select(F.lit("r").alias("id"), F.create_map(F.lit("m"), F.lit(2), F.lit("k"), F.lit(1)).alias("m"))
    assert changes.diff_snapshots(one, two).count() == 0
    whole = changes.diff_snapshots(one.withColumn("m", F.when(F.lit(False), F.col("m"))), two).first()
    assert whole.new_value == '{"k":"1","m":"2"}'


@pytest.mark.parametrize(
    "change",
    [("*", 'm["a"]', "9", "2"), ("-", 'm["a"]', "9", None), ("-", 'm["no"]', "1", None), ("+", 'm["a"]', None, "1"), ("*", "l[7]", "1", "2"), ("+", "l[0]", None, "1"), ("*", "no", "1", "2"), ("*", "m.x", "1", "2"), ("*", 'm["no"]["x"]', "1", "2"), ("*", "l[0].x", "1", "2")],
)
def test_a_wrong_change_is_refused(spark, change):
    base = spark.createDataFrame([("r", {"a": 1}, [5])], "id string, m map<string,int>, l array<int>")
    d = spark.createDataFrame([("r", *change)], "id string, op string, path string, old_value string, new_value string")
    with pytest.raises(ValueError, match="1 rows"):
        changes.patch(base, d)
    changes.patch(base, d, checked=False).collect()


def test_unchecked_patch_makes_what_is_above(spark):
    base = spark.createDataFrame([("r", None, None, None)], "id string, s struct<a:struct<b:int,c:int>>, m map<int,string>, l array<int>")
    d = spark.createDataFrame([("r", "*", "s.a.b", None, "5"), ("r", "+", 'm["3"]', None, "v"), ("r", "+", "l[1]", None, "8"), ("r", "+", "l[0]", None, "7")], "id string, op string, path string, old_value string, new_value string")
    r = changes.patch(base, d, checked=False).first()
    assert r.s.a.b == 5 and r.s.a.c is None and r.m == {3: "v"} and r.l == [7, 8]


def test_columns_that_came_and_audit_of_elements(spark):
    a = spark.createDataFrame([("r", 1)], "id string, n int")
    b = spark.createDataFrame([("r", 1, {"k": 1})], "id string, n long, m map<string,int>")
    c = spark.createDataFrame([("r", 1, {"j": 1})], "id string, n long, m map<string,int>")
    assert [(x.op, x.path, x.new_value) for x in changes.diff_snapshots(a, b).collect()] == [("*", "m", '{"k":"1"}')]
    log = changes.audit_changes(changes.diff_snapshots(b, c), "me", "", "api", "c", "N").collect()
    assert sorted((x["class"], x.attribute, x.old_value, x.new_value) for x in log) == [("Update", 'm["j"]', None, "1"), ("Update", 'm["k"]', "1", None)]


def test_empty_tables(spark):
    a = spark.createDataFrame([("r", {"k": 1})], "id string, m map<string,int>")
    assert rows(changes.patch(a, changes.diff_snapshots(a, a.limit(0)))) == [] and rows(changes.patch(a.limit(0), changes.diff_snapshots(a.limit(0), a))) == rows(a)
    assert changes.diff_snapshots(a.select("id"), a.select("id")).count() == 0
