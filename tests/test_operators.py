"""Operators on small tables: what the queries over the demonstration model do not show."""

import pytest
from pyspark.sql import functions as F

from entigraph import ClassDef, Slot, TypedGraph, TypeRegistry
from entigraph.functions import text
from entigraph.functions.stem import stem
from entigraph.operators import changes, hierarchy, navigate, path, search, validate, workflow
from entigraph.sources import entities, markdown

EDGES = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "q", "d"), ("d", "q", "d"), ("e", "p", "e")]


@pytest.fixture(scope="module")
def g(spark):
    reg = TypeRegistry([ClassDef("N", (), (Slot("p", "N"), Slot("q", "N"), Slot("color"), Slot("tags", many=True)))])
    rows = [("a", "n/a", "red", ["x", "y"]), ("b", "n/b", "blue", None), ("c", None, "red", ["x"]), ("d", "n/d", None, []), ("e", "n/e", "red", ["z", "z"])]
    nodes = spark.createDataFrame(rows, "id string, ident string, color string, tags array<string>")
    for pred in "pq":
        link = spark.createDataFrame([(s, d) for s, x, d in EDGES if x == pred], f"id string, {pred} string")
        nodes = nodes.join(link, "id", "left")
    return TypedGraph(spark, reg, {"N": nodes})


def reach(g, seeds, via):
    return {(r.seed, r.node) for r in path.follow(g, g.spark.createDataFrame([(s,) for s in seeds], "id string"), via).collect()}


def test_path_cycles_and_laws(g):
    p, q = path.P("p"), path.P("q")
    assert reach(g, "a", path.Plus(p)) == {("a", x) for x in "abc"}
    assert reach(g, "b", path.Star(q)) == {("b", "b")}
    every = "abcde"
    for via in (p, path.Seq(p, q), path.Plus(p), path.Or(p, path.Inv(q)), path.Rep(p, 1, 2)):
        assert reach(g, every, path.Inv(path.Inv(via))) == reach(g, every, via)
        assert {(b, a) for a, b in reach(g, every, via)} == reach(g, every, path.Inv(via))
    assert reach(g, every, path.Star(p)) == reach(g, every, path.Self()) | reach(g, every, path.Plus(p))
    assert reach(g, every, path.Rep(p, 0, 1)) == reach(g, every, path.Opt(p))
    assert reach(g, every, path.Any()) == {(s, d) for s, _, d in EDGES}
    assert reach(g, "a", path.Seq(path.Plus(p), path.Restrict("color", "red"))) == {("a", "a"), ("a", "c")}
    assert reach(g, "a", path.Seq(path.Plus(p), path.Restrict("tags", "y"))) == {("a", "a")}
    assert reach(g, "a", path.Filter(path.Plus(p), "n/")) == {("a", "a"), ("a", "b")}
    with pytest.raises(ValueError, match="no test"):
        reach(g, "a", path.Test(p, "nothing"))
    with pytest.raises(ValueError):
        path.Rep(p, 2, 1)


def test_paths_are_shortest_and_first_branch_wins(g, spark):
    rows = path.follow(g, spark.createDataFrame([("a",)], "id string"), path.Star(path.Any()), paths=True).collect()
    assert {r.node: len(r.path.edges) for r in rows} == {"a": 0, "b": 1, "c": 2, "d": 1}
    (r,) = path.follow(g, spark.createDataFrame([("d",)], "id string"), path.Or(path.Seq(path.P("q"), path.P("q")), path.P("q")), paths=True).collect()
    assert r.path.nodes == ["d", "d", "d"]
    one = path.follow(g, spark.createDataFrame([("a",)], "id string"), path.P("p"), paths=True)
    two = path.follow(g, spark.createDataFrame([("b",)], "id string"), path.P("p"), paths=True)
    both = path.concat_paths(one, two)
    assert both.first().path.nodes == ["a", "b", "c"]
    assert path.prefixes(one, both).count() == path.suffixes(two, both).count() == path.subpaths(two, both).count() == 1
    assert path.suffixes(one, both).count() == 0
    back = both.select(path.reverse_path().alias("path")).select(path.reverse_path().alias("path"))
    assert back.first() == both.first()


def test_walk_and_closure(g, spark):
    seeds = spark.createDataFrame([("a",), ("e",), (None,)], "id string")
    assert {(r.seed, r.node, r.hop) for r in navigate.graph_walk(seeds, g.edges(), None).collect()} == {("a", "b", 1), ("a", "d", 1), ("a", "c", 2)}
    assert navigate.graph_walk(seeds, g.edges(), 0).count() == 0
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), (None, "x")], "src string, dst string")
    assert {(r.src, r.dst) for r in hierarchy.closure(pairs).collect()} == {(a, b) for a in "ab" for b in "abc"}


def test_registry_rules():
    with pytest.raises(ValueError, match="not declared"):
        TypeRegistry([ClassDef("B", ("A",))])
    with pytest.raises(ValueError, match="otherwise"):
        TypeRegistry([ClassDef("A", (), (Slot("s"),)), ClassDef("B", (), (Slot("s", "long"),))])


def test_search_statistics(spark):
    rows = spark.createDataFrame([("1", "foo bar baz", "", ["Kettles", "x"]), ("2", "x", None, None)], "id string, name string, description string, tags array<string>")
    i = search.Index(rows, {"name": 12.0, "description": 8.0, "tags": 1.0})
    assert {r.field: r.avgdl for r in search.average_lengths(i.lengths).collect()} == {"name": 2.0, "description": 0.0, "tags": 1.0}
    assert {r.term: r.df for r in search.document_frequencies(i.postings).collect()} == {"foo": 1, "bar": 1, "baz": 1, "x": 2, "kettl": 1}
    assert [r.id for r in i.score("KETTLE nothing").collect()] == ["1"]
    parts = i.explain("x foo").groupBy("id").agg(F.round(F.sum("contribution"), 9).alias("s")).collect()
    assert {r.id: r.s for r in parts} == {r.id: round(r.score, 9) for r in i.score("x foo").collect()}
    assert i.score("").count() == 0
    with pytest.raises(ValueError):
        search.Index(rows, {})
    with pytest.raises(ValueError):
        search.field_index(rows, "name", ["tags"])


def test_stemmer_words():
    words = "caresses ponies cats feed agreed plastered motoring sing conflated sized hopping falling filing happy sky relational rational digitizer hopefulness goodness adoption cease controlling kettles at ÉTÉS"
    assert [stem(w) for w in words.split()] == "caress poni cat feed agre plaster motor sing conflat size hop fall file happi sky relat ration digit hope good adopt ceas control kettl at ÉTÉS".split()


def test_text_functions(spark):
    df = spark.createDataFrame([("## A b  ##", " Héllo, World! a--b ", "x/y/z.md", "a \r\nb  \n\n\n\nc\t\n\n")], "h string, s string, p string, b string")
    r = df.select(text.heading_level(F.col("h")), text.heading_text(F.col("h")), text.slugify(F.col("s")), text.path_ident(F.col("p")), text.directory(F.col("p")), text.normalize_body(F.col("b"))).first()
    assert tuple(r) == (2, "A b", "hllo-world-a-b", "x/y/z", "x/y/", "a\nb  \n\nc\n")


def test_patch_undoes_diff_and_checks(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", None, 2), ("3", "c", 3)], "id string, s string, n int")
    new = spark.createDataFrame([("1", "b", None), ("2", None, 2), ("4", "d", 4)], "id string, s string, n int")
    d = changes.diff_snapshots(old, new)
    assert sorted(changes.patch(old, d).collect()) == sorted(new.collect())
    with pytest.raises(ValueError, match="not as"):
        changes.patch(new, d)
    assert changes.diff_snapshots(old, old).count() == 0


def test_json_csv_and_upsert(spark, tmp_path):
    reg = TypeRegistry([ClassDef("T", (), (Slot("n", "long"), Slot("tags", many=True), Slot("at", "instant")), aliases={"num": "n"})])
    rows = spark.createDataFrame([("1", 5, ["a", "b"]), ("2", None, None)], "id string, n long, tags array<string>")
    at = f"file://{tmp_path}/j"
    entities.write_entities_json(rows, at, reg, "T")
    assert '{"_class":"T","id":"1","num":5,"tags":["a","b"]}' in [r.value for r in spark.read.text(at).collect()]
    assert sorted(map(tuple, entities.read_entities_json(spark, at, reg, "T").select("id", "n").collect())) == [("1", 5), ("2", None)]
    entities.write_csv_rows(rows, f"file://{tmp_path}/c")
    assert {r.tags for r in entities.read_csv_rows(spark, f"file://{tmp_path}/c").collect()} == {'["a","b"]', None}
    more = spark.createDataFrame([("1", ["c"]), ("3", ["z"])], "id string, tags array<string>")
    out = {r.id: r for r in entities.upsert_slots(rows, more, additive=True).collect()}
    assert out["1"].tags == ["a", "b", "c"] and out["1"].n == 5 and out["3"].tags == ["z"]
    assert {r.id: r.tags for r in entities.upsert_slots(rows, more).collect()}["1"] == ["c"]
    raw = spark.createDataFrame([("1", "x", "a, b", "2020-01-01")], "id string, n string, tags string, at string")
    r = entities.coerce_slots(raw, reg, "T").first()
    assert (r.n, r.tags, r["at"].year) == (None, ["a", "b"], 2020)


def test_markdown_round_trip(spark, tmp_path):
    source = "---\nname: x\n---\n\nBefore\n\n# One\n\ntext\n\n```\n# no heading\n```\n\n## Two ##\n\n### Three\n\n# Four\n\nend\n"
    front, before, sections = markdown.parse(source)
    assert front == {"name": "x"} and before == "Before"
    assert [(s[1], s[2], s[4]) for s in sections] == [(1, "One", None), (2, "Two", 0), (3, "Three", 1), (1, "Four", None)]
    docs = spark.createDataFrame([("d/a.md", {"name": "x"}, "Before"), ("b.md", {}, "")], "rel_path string, front map<string,string>, preamble string")
    secs = spark.createDataFrame([("d/a.md", *s) for s in sections], markdown.SECTION)
    markdown.write_markdown_corpus(docs, secs, str(tmp_path))
    back, parts = markdown.read_markdown_corpus(spark, str(tmp_path))
    assert {(r.rel_path, r.ident, r.preamble) for r in back.collect()} == {("d/a.md", "d/a", "Before"), ("b.md", "b", "")}
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, secs.collect()), key=str)
    assert markdown.corpus_roundtrip_check(docs, secs).count() == 0


def test_validation_runs(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    ok = spark.createDataFrame([(1, 1, 0)], "total int, valid int, invalid int")
    assert validate.validation_run(spark, at, "a", "N", lambda: ok) == "passed"
    assert validate.validation_run(spark, at, "b", "N", lambda: 1 / 0, retries=1) == "error"
    assert validate.recent_validations(spark.read.parquet(at), state="error").first().run_id == "b"
