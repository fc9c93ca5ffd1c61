import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from entigraph.llm import contamination as D

DOCS, BENCH = "doc_id long, text string, item_id long, words string", "item_id long, text string, doc_id long"


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, bench, window=13):
    grams = [(str(i) if i is not None else "", tuple(w[s : s + m])) for i, t, *_ in bench if (w := cut(t)) for m in [min(window, len(w))] for s in range(len(w) - m + 1)]
    out = []
    for d, t, *_ in docs:
        w, hit, items = cut(t), set(), set()
        for i, g in grams:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit.update(range(s, s + len(g)))
                    items.add(i)
        out.append((d, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fast(spark, docs, bench, window=13):
    out = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH), window).collect()
    return [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out]


key = repr


@pytest.mark.parametrize("seed", range(2))
def test_random_against_brute_force(spark, seed):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice("the of a b c d é X".split()) for _ in range(n))
    bench = [(i, say(r.randint(1, 9)), 0) for i in range(12)]
    docs = [(i, say(r.randint(0, 40)) + "! " + r.choice(bench)[1].upper() + "," + say(3), 0, "") for i in range(30)]
    assert sorted(fast(spark, docs, bench, 4), key=key) == sorted(slow(docs, bench, 4), key=key)


def test_edge_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = [(1, item, 0), (1, item, 0), (2, "short one", 0), (None, "lone", 0), (3, None, 0), (4, "...", 0), (5, "ha " * 14, 0)]
    docs = [(7, item, 0, ""), (7, item, 0, ""), (7, "other text", 0, ""), (None, "x " + item + " lone", 0, ""), (None, None, 0, ""), (8, "", 0, ""), (9, "ha " * 3000, 0, ""), (10, "a SHORT-one b", 0, ""), (11, "z " * 1000 + item, 0, ""), (12, item.replace("w7", "no"), 0, "")]
    got = sorted(fast(spark, docs, bench), key=key)
    assert got == sorted(slow(docs, bench), key=key)
    assert fast(spark, docs[:3], []) == [(d, n, 0, [], False) for d, n, *_ in slow(docs[:3], [])]
    assert fast(spark, [], bench) == []


def slow_matches(docs, bench, window=13, near=0.8):
    """(document, item, first word, size, matched) of every place where enough of a window's words stand, over the text's ends too."""
    out = set()
    for d, t, *_ in docs:
        w = cut(t)
        for i, b, *_ in bench:
            v = cut(b)
            m = min(window, len(v))
            for s in range(len(v) - m + 1):
                for at in range(-m, len(w)):
                    n = sum(0 <= at + k < len(w) and w[at + k] == v[s + k] for k in range(m))
                    if m and n and n >= near * m:
                        out.add((d, str(i), at, m, n))
    return out


def fast_matches(spark, docs, bench, **more):
    rows = D.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH), **more).collect()
    return {(r.d, r.item_id, h.start, h.size, h.matched) for r in rows for h in r.hits}


@pytest.mark.parametrize("seed", range(3))
def test_proximity_against_brute_force(spark, seed):
    """All matches, exact and near, of windows of several sizes, among them with words that no document has."""
    r = random.Random(seed)
    say = lambda n, of: [r.choice(of) for _ in range(n)]
    vocab = [f"w{i}" for i in range((6, 40, 400)[seed])]
    bench = [say(n, vocab) for n in (1, 2, 3, 5, 7, 13, 13, 16, 30)]
    docs = []
    for _ in range(40):
        w = say(r.randrange(25), vocab)
        for v in r.sample(bench, 2):
            v = list(v)
            for _ in range(r.randrange(4)):
                v[r.randrange(len(v))] = r.choice(["new", *vocab])
            w += v[r.randrange(3) :] + say(r.randrange(6), vocab)
        docs.append(w)
    docs = [(i, " ".join(w), 0, "") for i, w in enumerate(docs)]
    bench = [(i, " ".join([*v, *(["nowhere"] if i % 4 == 3 else [])]), 0) for i, v in enumerate(bench)]
    got = fast_matches(spark, docs, bench)
    assert got == slow_matches(docs, bench) and any(m < n for *_, n, m in got) and any(m == n for *_, n, m in got)


def test_proximity_match(spark):
    """Found whichever word is another, the rarest too."""
    item = [f"w{i}" for i in range(13)]
    docs = [(k, " ".join(["no" if i in (k, 12 - k) else w for i, w in enumerate(item)]), 0, "") for k in range(13)] + [(13, "w0 w1", 0, ""), (14, "w6", 0, "")]
    got = fast_matches(spark, docs, [(9, " ".join(item), 0)])
    assert got == {(k, "9", 0, 13, 12 if k == 6 else 11) for k in range(13)}
    out = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(9, " ".join(item), 0)], BENCH)).collect()
    assert {r.doc_id: list(r.near_items) for r in out} == {k: ["9"] if k < 13 else [] for k in range(15)} and not any(r.n_hit for r in out)


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "one two", "mine", 3, 4)], "doc_id long, text string, d string, th int, n_hit int")
    (r,) = D.contaminated(docs, spark.createDataFrame([(1, "one two", 0)], BENCH)).collect()
    assert (r.d, r["th"], r.n_hit, r.contaminated) == ("mine", 3, 2, True)


@pytest.mark.parametrize("changed", [False, True])
def test_against_sql(spark, tmp_path, changed):
    """The tables as they are, and with a common word changed, which makes proximity matches."""
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        if changed and t == "documents":
            rows = rows.withColumn("text", F.regexp_replace("text", "(?i) (and|der|la) ", " other "))
        rows.coalesce(1).write.parquet(f"file://{tmp_path}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(D.OP8_SQL).fetchall()
    got = [tuple(r) for r in D.op8_decontamination(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want) and sum(r[5] for r in got) > 5 and any(r[6] for r in got) == changed
