import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entigraph.llm import interaction as I
from tests.compare import differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, part string, n_words string, digest int"


def plain(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


def measured(texts, piece):
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    return I.measured(np.frombuffer(b"".join(data), np.uint8), bounds, piece).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ #|\n\t\x0b\x85\xa0é€😀", max_size=60), max_size=8), st.sampled_from([1, 2, 5, 16, 1 << 20]))
def test_transducer_is_plain_counting(texts, piece):
    assert measured(texts, piece) == [plain(t) for t in texts]


def test_long_texts_and_words():
    texts = ["one Two one " * 30_000, "", "x" * 5_000 + " é" * 3000 + " y", " ".join(f"w{i % 9000}" for i in range(60_000)), "   "]
    for piece in (1000, 1 << 16, 1 << 20):
        assert measured(texts, piece) == [plain(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(I, "_POWERS", type("P", (), {"of": lambda self, n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64))})())  # every word has hash 0
    texts = ["b a b ab ba ab c", "b a", "ab ab"]
    assert measured(texts, 1 << 20) == [plain(t) for t in texts]


def brute(rows, labels):
    """rows (doc_id, text, part): each document goes through each order by itself."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    seen = []
    for i, t, part in rows:
        w, distinct, capitals, chars, symbols = plain(t or "")
        fails = {x for x, bad in zip("ABCDE", (w < 50, 100 * distinct < 65 * w, 100 * capitals > 5 * chars, symbols > 0, i is not None and i > first[t or ""]), strict=True) if bad}
        seen.append((part or "", fails, *(int(any(j == i and v[k] == 1 for j, *v in labels)) for k in (0, 1))))
    shapley, out = Counter(), defaultdict(lambda: [0] * 6)
    for order in permutations("ABCDE"):
        for part, fails, good, toxic in seen:
            gone = False
            for step, x in enumerate(order, 1):
                o = out[part, "".join(order), step]
                bad = x in fails
                o[3] += fails == {x}
                if bad and not gone:
                    o[1] += 1
                    o[4] += good
                    o[5] += toxic
                    shapley[part, x] += 1
                o[2] += bad and gone
                gone |= bad
                o[0] += not gone
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    given = {}
    for i, g, t in labels:
        a, b = given.get(i, (0, 0))
        given[i] = max(a, int(g == 1)), max(b, int(t == 1))
    by = spark.createDataFrame([(i, *v) for i, v in given.items() if i is not None], "doc_id long, good int, toxic int")
    f = I.failures(docs).join(by, "doc_id", "left").na.fill(0)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in I.audit(f.select("part", "fails", f.good.cast("long"), f.toxic.cast("long")), "ABCDE").collect()}


def test_same_as_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, "a"), (2, long, "b"), (3, long, "a"), (3, long, "a"), (1, long, "b"), (None, long, "a"), (4, None, None), (5, "", ""), (6, "AAA BBB", "a"), (7, "same " * 100, "a"), (8, long + " $", "b"), (9, ("SHOUT| " * 60), "b"), (10, long.upper(), "a"), (11, None, "a")]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (8, None, 1), (9, 1, 1), (None, 1, 1), (999, 1, 1)]
    got = audited(spark, rows, labels)
    assert got == brute(rows, labels) and len(got) == 3 * 600


def test_repeats_everywhere_and_empty_table(spark):
    rows = [(i, "one and the same", "a" if i % 3 else None) for i in range(300)]
    assert audited(spark, rows, [(5, 1, 1)]) == brute(rows, [(5, 1, 1)])
    none = I.audit(I.failures(spark.createDataFrame([], SCHEMA)).selectExpr("part", "fails", "0L as good", "0L as toxic"), "ABCDE")
    assert none.count() == 0 and len(none.columns) == 10
    with pytest.raises(ValueError, match="more than 6"):
        I.audit(none, "ABCDEFG")


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(spark, I.op12_interaction, I.OP12_SQL, sf) == ""


def test_sql_with_nulls_and_ties(spark, tmp_path):
    db = duckdb.connect()
    db.execute("create table documents as select * from (values (1, 'x y z', 's'), (2, 'x y z', null), (3, null, 's'), (4, '', 't'), (2, 'A A A', 't')) t(doc_id, text, source)")
    db.execute("create table labels as select * from (values (1, 1, null), (2, 0, 1), (2, 1, 0)) t(doc_id, quality, toxic)")
    for t in ("documents", "labels"):
        db.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    assert differences(spark, I.op12_interaction, I.OP12_SQL, str(tmp_path), db) == ""
