"""Saved indexes: segments, retractions, the lexicon."""

import random

import pytest
from pyspark.sql import functions as F

from entigraph.operators import search

WORDS = ["steel", "steal", "stele", "kettle", "kettles", "kettling", "old", "olden", "x", "of", "the", "été", "a" * 45, "a" * 44 + "b"]
SCHEMA = "id string, t string, tags array<string>"
WEIGHTS = {"t": 3.0, "tags": 1.0}


def made(r, ids):
    return [(i, " ".join(r.choices(WORDS, k=r.randrange(8))), r.choice([None, [], r.choices(WORDS, k=2)])) for i in ids]


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Three segments, of which later ones replace and retract parts of earlier ones, and what is left as rows."""
    r, at, now = random.Random(2), f"file://{tmp_path_factory.mktemp('index')}/i", {}
    for ids in (range(0, 20), range(15, 25), range(5, 8)):
        rows = made(r, map(str, ids))
        search.append(spark.createDataFrame(rows, SCHEMA), at, WEIGHTS)
        now |= {x[0]: x for x in rows}
        gone = [str(i) for i in r.sample(range(25), 3)]
        search.retract(spark.createDataFrame([(i,) for i in [*gone, "none"]], "id string"), at)
        for i in gone:
            now.pop(i, None)
    return search.Index.open(spark, at, WEIGHTS), search.Index(spark.createDataFrame(list(now.values()), SCHEMA), WEIGHTS), now


def test_scores_equal_those_of_a_fresh_index(spark, kept):
    index, fresh, now = kept
    for q in ("kettles of steel", "the old", "nothing"):
        rank = lambda i, q=q: {x.id: round(x.score, 9) for x in i.score(q).collect()}
        assert rank(index) == rank(fresh)
    many = spark.createDataFrame([(1, "Kettle x"), (2, "été OF")], "query_id int, query string")
    rank = lambda i: {(x.query_id, x.id): round(x.score, 9) for x in i.score(many).collect()}
    assert rank(index) == rank(fresh)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, fresh.postings.collect()))
    assert {tuple(x) for x in index.averages.collect()} == {tuple(x) for x in fresh.averages.collect()} and index.n.first() == fresh.n.first()
    assert {x.id for x in index.ids().collect()} == set(now)


def test_first_hits_of_many_queries_are_those_of_all_scores(spark, kept):
    index, fresh, _ = kept
    copies = spark.createDataFrame([(f"c{i:02}", "old kettle of steel" if i % 3 else "old olden kettles", None) for i in range(30)], SCHEMA)
    many = spark.createDataFrame([(i, ["Kettle x", "old kettles", "OLD kettle old", "of", "", "none"][i % 6]) for i in range(30)], "query_id int, query string")
    told = lambda df: sorted((x.query_id, x.rank, x.id, round(x.score, 8)) for x in df.collect())
    for i, limits in ((index, (3,)), (search.Index(fresh.rows.union(copies), WEIGHTS), (1, 50))):
        for limit in limits:
            assert told(i.top(many, limit)) == told(search.best(i.score(many).withColumn("score", F.round("score", 9)), limit))
    assert told(index.top("old kettles", 2, {"t": 1.0})) == told(search.best(index.score("old kettles", {"t": 1.0}).withColumn("score", F.round("score", 9)), 2))


@pytest.mark.parametrize("stem", [True, False])
def test_postings_are_made_within_rows(spark, stem):
    rows = spark.createDataFrame([("a", "old kettles, Kettles old x", ["été"]), ("b", None, None), ("c", "", ["kettle", "kettles kettle"]), ("a", "old", [])], SCHEMA)
    posted = search._posted(search.analysed(rows, WEIGHTS), stem)
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    got = [(r.id, r.field, r.len, sorted((p.word, p.term, p.positions) for p in r.posted)) for r in posted.collect()]
    k = "kettl" if stem else "kettle"
    ks = "kettl" if stem else "kettles"
    assert sorted(got) == sorted([
        ("a", "t", 5, [("kettles", ks, [1, 2]), ("old", "old", [0, 3]), ("x", "x", [4])]), ("a", "tags", 1, [("été", "été", [0])]), ("a", "t", 1, [("old", "old", [0])]), ("a", "tags", 0, []),
        ("b", "t", 0, []), ("b", "tags", 0, []), ("c", "t", 0, []), ("c", "tags", 3, [("kettle", k, [0, 2]), ("kettles", ks, [1])]),
    ])
    counts = search.term_counts(rows, WEIGHTS, stem=stem)
    assert {r.term: r.n for r in counts.collect()} == ({"old": 3, "kettl": 5, "x": 1, "été": 1} if stem else {"old": 3, "kettles": 3, "kettle": 2, "x": 1, "été": 1})


@pytest.mark.parametrize("stem", [True, False])
def test_postings_group_texts_and_not_tokens(spark, stem):
    rows = spark.createDataFrame([("a", "old kettles, Kettle old x", ["été"]), ("b", None, None), ("c", "", ["kettle", "kettles kettle"]), ("a", "old", []), (None, "x x", ["x"])], SCHEMA)
    posted = search.Index(rows, WEIGHTS, stem=stem).postings
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan
    want = search.postings(search.tokens(rows, WEIGHTS, stem=stem)).collect()
    assert posted.columns == ["id", "field", "term", "tf"] and sorted(map(str, posted.collect())) == sorted(map(str, want))
    assert search.Index(rows.limit(0), WEIGHTS, stem=stem).postings.count() == 0


def test_queries_of_the_same_terms_are_scored_once(spark):
    """40 queries over 200 texts, of two kinds each: the joined rows of scores are those of the kinds."""
    rows = spark.createDataFrame([(f"{i:03}", "old kettle" if i % 2 else "old steel", None) for i in range(200)], SCHEMA)
    many = spark.createDataFrame([(i, "old kettle" if i % 2 else "steel") for i in range(40)], "query_id int, query string")
    made, kept_of = [], search._scores
    try:
        search._scores = lambda df: made.append(df.count()) or kept_of(df)
        got = search.Index(rows, WEIGHTS).top(many, 5).collect()
    finally:
        search._scores = kept_of
    assert len(got) == 200 and sum(made) <= 6


@pytest.mark.parametrize("few", [1_000, 0])
def test_conditions_equal_brute_force(kept, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    index, fresh, now = kept
    words = {i: [(f, (t or "").lower().split()) for f, t in (("t", x[1]), ("tags", " ".join(x[2] or [])))] for i, x in now.items()}
    has = lambda test: {i for i, fs in words.items() if any(test(w) for _, ws in fs for w in ws)}
    got = lambda i, **more: {x.id for x in search.matching(i, **more).collect()}
    for i in (index, fresh) if few else (index,):
        for word, distance in (("steel", 1), ("steel", 2), ("ketle", 3), ("a" * 45, 2), ("x", 0)):
            assert got(i, fuzzy=word, distance=distance) == has(lambda w, word=word, distance=distance: edits(w, word) <= distance)
        assert got(i, prefix="KETT") == has(lambda w: w.startswith("kett")) and got(i, prefix="a", none_of=["of"]) == has(lambda w: w.startswith("a")) - has(lambda w: w == "of")
        assert got(i, all_of=["of", "the"], fuzzy="stele", distance=1) == has(lambda w: w == "of") & has(lambda w: w == "the") & has(lambda w: edits(w, "stele") <= 1)
        assert got(i, none_of=["the"]) == set(now) - has(lambda w: w == "the") and got(i) == set(now)
        for phrase in ("the of", "of of", "old x the"):
            at = phrase.split()
            want = {k for k, fs in words.items() if any(ws[n : n + len(at)] == at for _, ws in fs for n in range(len(ws)))}
            assert got(i, phrase=phrase) == want and got(i, phrase=phrase, any_of=["x"]) == want & has(lambda w: w == "x")


def test_a_prefix_reads_a_range_of_the_lexicon(kept):
    index, *_ = kept
    plan = index.words_like(prefix="kett")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(word,kett)" in plan
    plan = search.matching(index, all_of=["the"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,the)" in plan


def test_kept_index_is_made_again_when_files_change(spark, tmp_path):
    at = f"file://{tmp_path}/rows"
    spark.createDataFrame([("1", "steel", None)], SCHEMA).write.parquet(at)
    open_ = lambda: search.kept_index(spark.read.parquet(at), WEIGHTS)
    first = open_()
    assert open_().path == first.path and {x.id for x in first.score("steel").collect()} == {"1"}
    spark.createDataFrame([("2", "steel", None)], SCHEMA).write.mode("append").parquet(at)
    assert {x.id for x in open_().score("steel").collect()} == {"1", "2"}
    assert open_().lexicon().select(F.sum("n")).first()[0] == 2
