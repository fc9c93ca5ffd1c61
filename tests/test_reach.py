"""Long chains, cycles and dense graphs."""

import random
from collections import defaultdict

import pytest

from entigraph import ClassDef, Slot, TypedGraph, TypeRegistry, scratch
from entigraph.operators import hierarchy, navigate, path, reach


def distances(pairs):
    to = defaultdict(set)
    for a, b in pairs:
        to[a].add(b)
    out = {}
    for s in list(to):
        front, hop, seen = {s}, 0, set()
        while front:
            hop += 1
            front = {b for a in front for b in to[a]} - seen
            seen |= front
            out |= {(s, b): hop for b in front}
    return out


R = random.Random(4)
CHAIN = [(f"n{i}", f"n{i + 1}") for i in range(12)]
GRAPHS = {
    "two cycles that meet": (4, [*CHAIN, ("n12", "n0"), ("n11", "n3"), ("n12", "x"), ("x", "x")]),
    "dense, with a tail": (4, [(f"d{R.randrange(9)}", f"d{R.randrange(9)}") for _ in range(30)] + [("d0", "n0"), *CHAIN]),
    "in single strides": (0, CHAIN[:9]),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_closure_is_that_of_single_steps(spark, monkeypatch, name):
    growth, pairs = GRAPHS[name]
    monkeypatch.setattr(reach, "GROWTH", growth)
    assert {(r.src, r.dst): r.hop for r in hierarchy.closure(spark.createDataFrame(pairs, "src string, dst string")).collect()} == distances(pairs)


def test_walks_of_many_hops(spark):
    _, pairs = GRAPHS["two cycles that meet"]
    edges, seeds = spark.createDataFrame([(a, "p", b) for a, b in pairs], "src string, predicate string, dst string"), spark.createDataFrame([("n0",), ("x",)], "id string")
    own = {(a, b): h for (a, b), h in distances(pairs).items() if a in ("n0", "x") and a != b and h <= 9}
    assert {(r.seed, r.node): r.hop for r in navigate.graph_walk(seeds, edges, 9).collect()} == own


def test_repetition_of_a_long_cycle(spark):
    n = 10
    g = TypedGraph(spark, TypeRegistry([ClassDef("N", (), (Slot("to", "N"), Slot("back", "N")))]), {"N": spark.createDataFrame([(f"n{i}", f"n{(i + 1) % n}", f"n{(i - 1) % n}") for i in range(n)], "id string, to string, back string")})
    seeds = spark.createDataFrame([("n3",)], "id string")
    reached = lambda via: {r.node for r in path.follow(g, seeds, via).collect()}
    assert reached(path.Plus(path.P("to"))) == {f"n{i}" for i in range(n)}
    assert reached(path.Star(path.Seq(path.P("to"), path.Inv(path.P("back"))))) == {f"n{i}" for i in range(n) if i % 2}


def test_a_cycle_of_ten_thousand_links_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    pairs = spark.range(n).selectExpr("cast(id as string) as src", f"cast((id + 1) % {n} as string) as dst")
    written = []
    monkeypatch.setattr(reach, "stored", lambda df, name, keep=reach.stored: written.append(name) or keep(df, name))
    monkeypatch.setattr(hierarchy, "bucketed", lambda *a, keep=hierarchy.bucketed: written.append(a[1]) or keep(*a))
    out = hierarchy.closure(pairs, spark.createDataFrame([("7",)], "src string"))
    assert out.count() == n and out.selectExpr("max(hop)").first()[0] == n
    assert len(written) <= reach.FIRST + 3 + 20 + 20 / reach.BATCH  # a table for each first step, each doubling and each batch


def test_what_was_found_is_not_moved_again(spark):
    """The plan of a late round's comparison has an exchange over what is new, none over the rounds before."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rounds = [scratch.bucketed(spark.range(k, k + 50).selectExpr("id as seed", "id as node"), "walk", "seed", "node") for k in (0, 30)]
        found = spark.range(100).selectExpr("id as seed", "id as node").distinct()
        for r in rounds:
            found = found.join(r, ["seed", "node"], "left_anti")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2 and found.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cleared_drops_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with scratch.cleared(spark):
        assert scratch.bucketed(spark.range(5), "t", "id").count() == 5
    assert {t.name for t in spark.catalog.listTables()} == before
