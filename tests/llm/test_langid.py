from collections import Counter

from entigraph.llm import langid as L


def slow_top(text, size):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    n = Counter()
    for w in words:
        p = f"_{w}_"
        for k in (1, 2, 3):
            for i in range(len(p) - k + 1):
                if p[i : i + k] != "_":
                    n[p[i : i + k]] += 1
    number = lambda g: sum((1 if c == "_" else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(((number(g), c) for g, c in n.items()), key=lambda x: (-x[1], x[0]))][:size]


def test_top_against_brute_force():
    for text in ["", "a", "Die Straße, der Über-Fluß! 12 x", "ab ab abc\n\nab", "İx ς Σ 漢字 漢", "#!?"]:
        for size in (3, 400):
            assert L.top(text, size).tolist() == slow_top(text, size), text


def test_learning_counts_all_rows(spark):
    rows = [("en", "the cat"), ("en", "the dog"), ("de", "der Hund"), (None, "le chien"), ("fr", None)]
    got = dict(L.learn(spark.createDataFrame(rows, "lang string, text string"), 5))
    assert got["en"] == slow_top("the cat the dog", 5) and got["de"] == slow_top("der Hund", 5)
    assert "fr" not in got


def test_distance_by_hand():
    p = L.Profiles([("a", L.top("aaa").tolist()), ("b", L.top("bbb").tolist())], 400)
    own = L.top("aaa")
    assert p.best("aaa") == ("a", 1.0)
    assert p.best("zzz") == ("a", 0.0)  # equally far from both
    assert len(own) and p.best("123") == p.best(None) == p.best("") == ("und", 0.0)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the end", "x", 1.0), (1, "the end", "x", 1.0), (None, None, None, None), (2, "! 1", "y", 2.0), (3, "der " * 50000, "y", 2.0)], "doc_id long, text string, lang_pred string, score double")
    learned = [("de", L.top("der die das").tolist()), ("en", L.top("the a of end").tolist())]
    out = sorted((r.doc_id or 0, r.lang_pred) for r in L.predict(docs, learned).collect())
    assert out == [(0, "und"), (1, "en"), (1, "en"), (2, "und"), (3, "de")]
    assert {r.lang_pred for r in L.predict(docs, []).collect()} == {"und"}
    assert L.predict(docs.limit(0), learned).count() == 0


def test_held_out_accuracy(spark):
    out = L.op5_language_id(spark, "/root/testdata/sf0.01").alias("o").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
