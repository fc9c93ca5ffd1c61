"""Operators that no query shows."""

import random

import pytest
from pyspark.sql import functions as F

from entigraph import ClassDef, Slot, TypedGraph, TypeRegistry, scratch
from entigraph.operators import access, aggregate, events, navigate, path, search, validate
from entigraph.operators.rules import per_row
from entigraph.sources import entities, markdown
from entigraph.streaming.jobs import drained


@pytest.fixture(scope="module")
def g(spark):
    reg = TypeRegistry([ClassDef("N", (), (Slot("to", "N"), Slot("many", "N", many=True))), ClassDef("M", ("N",), (Slot("at", "K"),)), ClassDef("K", (), (Slot("on", "K"),))])
    n = spark.createDataFrame([("a", "b", ["b", "b", "c"]), ("b", None, None)], "id string, to string, many array<string>")
    return TypedGraph(spark, reg, {"N": n, "M": spark.createDataFrame([("m", "k")], "id string, at string"), "K": spark.createDataFrame([("k", "k")], "id string, on string")})


def test_edges_by_the_class_model(g):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(g.edges()) == [("a", "many", "b"), ("a", "many", "c"), ("a", "to", "b"), ("k", "on", "k"), ("m", "at", "k")]
    assert rows(g.edges(near="K")) == [("k", "on", "k"), ("m", "at", "k")]
    assert rows(g.edges(near="M")) == [("a", "many", "b"), ("a", "many", "c"), ("a", "to", "b"), ("m", "at", "k")]
    assert rows(g.edges_within("M", 1)) == [("m", "at", "k")] and rows(g.edges_within("K", 3)) == [("k", "on", "k")]
    assert len(rows(g.edges_within("M", 2))) == 5  # `to` leads from an M to an N by the model, though this table has no such column
    assert len(rows(g.edges_within("K", 1, "inverse"))) == 2
    assert rows(g.edges_within("N", 9, "both")) == rows(g.edges())


def test_join_ref_and_group_total(g):
    out = g.join_ref(g.scan_class("N"), "to", "N", "t_").select("id", "t_id").collect()
    assert [tuple(r) for r in out] == [("a", "b")]
    groups = aggregate.group_by(g.scan_class("N"), "to")
    assert aggregate.group_total(groups).first().total == 1 and aggregate.group_total(groups.limit(0)).first().total == 0


def test_roles_and_correlated_events(spark):
    held = spark.createDataFrame([("p", "admin")], "principal string, role string")
    asked = spark.createDataFrame([("p", "admin"), ("p", "other"), ("q", "admin")], "principal string, role string")
    assert [tuple(r) for r in access.has_role(asked, held).collect()] == [("p", "admin")]
    e = spark.createDataFrame([("1", 5, "c"), ("2", 3, "c"), ("3", 1, None), ("4", 1, "d")], "id string, ts int, correlation_id string")
    assert [r.id for r in events.events_by_correlation(e, "c").collect()] == ["2", "1"]


def test_path_columns(g, spark):
    w = path.follow(g, spark.createDataFrame([("a",)], "id string"), path.P("to"), paths=True)
    r = w.select(path.node_at(F.lit(1)).alias("n"), path.edge_at(F.lit(0))["predicate"].alias("e"), path.node_at(F.lit(7)).alias("none"), path.extend(F.lit("q"), F.lit("forward"), F.lit("z")).alias("path")).first()
    assert (r.n, r.e, r.none) == ("b", "to", None)
    assert r.path.nodes == ["a", "b", "z"] and [tuple(x) for x in r.path.edges] == [("to", "forward"), ("q", "forward")]


@pytest.mark.parametrize("name, value, holds", [("neg?", "x/-4", True), ("neg?", "x/4", False), ("pos?", "4", True), ("pos?", "-4", False), ("true?", "true", True), ("false?", "true", False), ("false?", "false", True), ("not-empty", "", False), ("coll?", "a", False), ("map?", "a", False)])
def test_node_tests(spark, name, value, holds):
    assert bool(spark.createDataFrame([(value,)], "node string").select(path.TESTS[name](F.col("node"))).first()[0]) == holds


def test_saved_index_and_analysed_conditions(spark, tmp_path):
    rows = spark.createDataFrame([("1", "The steel kettles", ["Old", "x"]), ("2", "a kettle of steel", None), ("3", None, []), ("4", "", ["kettling"])], "id string, t string, tags array<string>")
    made = search.Index(rows, {"t": 3.0, "tags": 1.0})
    at = f"file://{tmp_path}/i"
    made.save(at)
    loaded = search.Index(rows, {"t": 3.0, "tags": 1.0}).load(at)
    rank = lambda i, q, **more: {r.id: round(r.score, 9) for r in i.score(q, **more).collect()}
    ids = lambda i, **more: {r.id for r in search.matching(i, **more).collect()}
    for q in ("Kettles", "the STEEL", "nothing", ""):
        assert rank(loaded, q) == rank(made, q)
    assert rank(made, "kettles").keys() == {"1", "2", "4"}
    assert sorted(map(tuple, loaded.postings.collect())) == sorted(map(tuple, made.postings.collect()))
    for i in (made, loaded):
        assert ids(i, all_of=["The"]) == {"1"} and ids(i, phrase="The steel") == {"1"} and ids(i, phrase="Steel kettling") == {"1"}
        assert ids(i, all_of=["KETTLES"]) == {"1", "2", "4"} and ids(i, all_of=["steel kettle"]) == {"1", "2"}
        assert ids(i, prefix="Kettles") == {"1"} and ids(i, fuzzy="Kettlin", distance=1) == {"4"} and ids(i, any_of=["old", "of"]) == {"1", "2"} and ids(i, none_of=["kettle"]) == {"3"}
    plain = search.Index(rows, {"t": 1.0}, stem=False)
    assert rank(plain, "kettles").keys() == {"1"} and ids(plain, all_of=["Kettles"]) == {"1"}


def test_chains_are_ordered_in_doubling_rounds(spark):
    r = random.Random(4)
    names = [f"s{i}" for i in range(70)]
    r.shuffle(names)
    rows = [(a, b) for a, b in zip(names[:40], names[1:40], strict=False)] + [(names[39], None)]  # a chain of 40
    rows += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("alone", None), ("t1", names[38])]  # a cycle, a lone section, and a second way into the chain's end
    got = {(x.head, x.id, x.ord) for x in navigate.section_chain(spark.createDataFrame(rows, "id string, next_sibling string")).collect()}
    want = {(names[0], n, i) for i, n in enumerate(names[:40])} | {("alone", "alone", 0), ("t1", "t1", 0), ("t1", names[38], 1), ("t1", names[39], 2)}
    assert got == want
    tail = spark.createDataFrame([("h", "x"), ("x", "y"), ("y", "x")], "id string, next_sibling string")  # a chain that runs into a cycle
    assert {(x.id, x.ord) for x in navigate.section_chain(tail).collect()} == {("h", 0), ("x", 1), ("y", 2)}


def test_siblings_with_a_limit_against_all(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(f"i{k:02}", r.choice(["", "d/", "d/e/"]) + str(k)) for k in range(40)] + [("none", None)], "id string, p string")
    every, few = ({} for _ in range(2))
    for out, limit in ((every, 0), (few, 4)):
        for x in navigate.siblings(rows, rows, "p", limit).collect():
            out.setdefault(x.seed, []).append(x.node)
    assert {s: sorted(n)[:4] for s, n in every.items()} == {s: sorted(n) for s, n in few.items()}


def test_rules_that_fail_are_rows(spark):
    reg = TypeRegistry([ClassDef("T", (), (Slot("n"),))])
    rows = spark.createDataFrame([("1", "5"), ("2", "abc"), ("3", None), ("4", "-1")], "id string, n string")
    rule = lambda: per_row(lambda r: "negative" if int(r["n"]) < 0 else None, ["n"], "string", validate.failure)
    got = {r.id: r.error for r in validate.validate(rows, reg, "T", validators={"T": rule}).collect()}
    assert got == {"2": "validator-error: ValueError", "3": "validator-error: TypeError", "4": "negative"}
    gone = validate.validate(rows, reg, "T", validators={"T": lambda: F.col("nothing")}).collect()
    assert {r.error for r in gone} == {"validator-error: columns are missing"} and len(gone) == 4
    assert tuple(validate.validate_all(rows, reg, "T", validators={"T": rule}).first()) == (4, 1, 3)
    targets = {"n": spark.createDataFrame([("5",), ("5",), ("abc",)], "id string")}
    assert tuple(validate.validate_all(rows, reg, "T", targets).first()) == (4, 3, 1)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)


def test_scratch_tables_are_cleared(spark):
    import os

    with scratch.cleared(spark):
        df = scratch.stored(spark.range(3))
        (at, *_) = df.inputFiles()
        assert os.path.exists(at.replace("file://", "")) and df.count() == 3
    assert not os.path.exists(at.replace("file://", ""))
    kept = scratch.stored(spark.range(2))
    assert kept.count() == 2


def test_formats_of_classes(spark, tmp_path):
    slots = (Slot("n", "long"), Slot("tags", many=True))
    reg = TypeRegistry([ClassDef("J", (), slots, aliases={"num": "n"}), ClassDef("C", (), slots, format="csv"), ClassDef("P", (), slots, format="parquet"), ClassDef("X", (), slots, format="xml")])
    rows = spark.createDataFrame([("1", 5, ["a", "b"]), ("2", None, None)], "id string, n long, tags array<string>")
    for name in "JCP":
        entities.write_entities(rows, f"file://{tmp_path}/{name}", reg, name)
        back = entities.read_entities(spark, f"file://{tmp_path}/{name}", reg, name).select("id", "n", "tags")
        assert sorted(map(tuple, back.collect())) == [("1", 5, ["a", "b"]), ("2", None, None)]
    with pytest.raises(ValueError, match="xml"):
        entities.write_entities(rows, f"file://{tmp_path}/X", reg, "X")


def test_corpus_in_a_table(spark, tmp_path):
    docs = spark.createDataFrame([("d/a.md", {"name": "x"}, "Before"), ("b.md", {}, "")], "rel_path string, front map<string,string>, preamble string")
    secs = spark.createDataFrame([("d/a.md", 0, 1, "One", "text", None)], markdown.SECTION)
    at = f"file://{tmp_path}/c"
    markdown.write_corpus_table(docs, secs, at, F.concat(F.lit("new/"), "rel_path"))
    back, parts = markdown.read_markdown_corpus(spark, at, "new/d")
    assert [(r.rel_path, r.preamble) for r in back.collect()] == [("new/d/a.md", "Before")] and [r.heading for r in parts.collect()] == ["One"]


def test_update_mode_gives_the_last_row_of_a_key(spark, tmp_path):
    for i, v in enumerate([["a", "b"], ["a"], ["a", "c"]]):
        spark.createDataFrame([(x,) for x in v], "k string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    s = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    counts = s.groupBy("k").count()
    assert sorted(map(tuple, drained(counts, f"file://{tmp_path}/s", "update", ("k",)).collect())) == [("a", 3), ("b", 1), ("c", 1)]
    with pytest.raises(ValueError, match="key"):
        drained(counts, f"file://{tmp_path}/t", "update")


def test_python_rules_see_the_values_of_the_row(spark):
    rows = spark.createDataFrame([(2**53 + 1, [1], {"k": None}), (None, None, None), (5, [], {})], "n long, l array<int>, m map<string,int>")
    seen = rows.select(per_row(lambda r: repr((r["n"], r["l"])), ["n", "l"], "string").alias("s"), per_row(lambda r: r["n"] is None, ["n"]).alias("none"), per_row(lambda r: r["n"], ["n"], "long").alias("n"))
    assert [tuple(r) for r in seen.collect()] == [(f"({2**53 + 1}, [1])", False, 2**53 + 1), ("(None, None)", True, None), ("(5, [])", False, 5)]
