import random

import numpy as np
import pytest

from entigraph.llm import passages as P

SCHEMA = "doc_id long, text string, key string, rid int"


@pytest.mark.parametrize("width", [1, 3, 7])
def test_compact_windows_cover_every_passage_once(width):
    r = random.Random(width)
    for n in (0, 2, 5, 40):
        h = np.array([r.randrange(12) for _ in range(n)], np.uint64)
        got = P.compact_windows(h, width)
        for a in range(n):
            for b in range(a + width - 1, n):
                c = a + int(h[a : b + 1].argmin())
                assert [w for w in got if w[1] <= a <= w[0] <= b <= w[2]] == [w for w in got if w[0] == c]
                assert sum(w[0] == c for w in got) == 1


def test_shingle_numbers_do_not_depend_on_place_or_blanks():
    a, b = P.shingles(b"one Two three four five six"), P.shingles(b"x  y\none two\tTHREE four five  six z")
    assert len(a) == 2 and a.tolist() == b.tolist()[2:4] and len(set(b.tolist())) == 5
    assert len(P.shingles(b"a b c d")) == len(P.shingles(b"")) == 0


def words(r, n):
    return [f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n)]


def test_similar_stretches():
    r = random.Random(5)
    p = words(r, 80)
    a, b = words(r, 30) + p + words(r, 20), words(r, 7) + p + words(r, 9)
    assert [x[:4] for x in P.similar_stretches(a, b)] == [(30, 110, 7, 87)]
    q = list(p)
    q[40] = "changed"
    ((i, j, k, m, s),) = P.similar_stretches(a, words(r, 7) + q)
    assert (i, j, k, m) == (30, 110, 7, 87) and 0.8 <= s < 1
    assert P.similar_stretches(words(r, 60) + p[:40], p[:40] + words(r, 60)) == []


def test_similar_ranges_inside_a_group():
    r = random.Random(6)
    p, phrase = words(r, 60), words(r, 5)
    q = list(p)
    q[30] = "changed"
    ((i, j, k, m, s),) = P.similar_stretches(p + words(r, 6) + phrase + words(r, 9), q + words(r, 6) + phrase)
    assert (i, j, k, m) == (0, 60, 0, 60) and s >= 0.8


@pytest.mark.parametrize("seed", range(8))
def test_similar_ranges_against_brute_force(seed):
    """Random edits, of the same words again and again too: each similar range of runs is in one that is told, and what is told is similar."""
    r = random.Random(seed)
    base = words(r, 260) if seed % 2 else [r.choice("abcdefghijklmnopqrst") for _ in range(260)]
    changed = list(base)
    for at in r.sample(range(260), 26):
        changed[at] = words(r, 1)[0]
    x, y = ([tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in (base, changed))
    runs = []
    for i in range(len(x)):
        if x[i] == y[i]:
            runs = runs[:-1] + [(runs[-1][0], i, runs[-1][2])] if runs and runs[-1][1] == i - 1 else [*runs, (i, i, i)]
    assert len(runs) > 2
    outside = set(range(len(x))) - {i for a, z, _ in runs for i in range(a, z + 1)}
    if any(x[i] in set(y) for i in outside):
        pytest.skip("a shingle between runs is in y")

    def similar(u, v):
        p, q = set(x[runs[u][0] : runs[v][1] + 1]), set(y[runs[u][0] : runs[v][1] + 1])
        return runs[v][1] - runs[u][0] + 1 >= 46 and len(p & q) / len(p | q) >= 0.8

    got = P._similar_ranges(x, y, runs, 46, 0.8)
    want = {(u, v) for u in range(len(runs)) for v in range(u, len(runs)) if similar(u, v)}
    assert set(got) == {(u, v) for u, v in want if not any((a, z) != (u, v) and a <= u and v <= z for a, z in want)}


def test_planted_passages_and_edge_rows(spark):
    r = random.Random(9)
    p, near = words(r, 55), words(r, 120)
    changed = list(near)
    changed[60] = "other"
    whole = words(r, 300)
    docs = [
        (1, words(r, 100) + p), (2, p + words(r, 30)), (3, words(r, 40) + p + words(r, 400)), (4, words(r, 200)), (5, whole), (6, whole), (7, near), (8, words(r, 10) + changed),
        (9, words(r, 100) + p[:30]), (10, []), (11, words(r, 3)), (12, ["ha"] * 5000), (None, words(r, 9) + p),
    ]
    rows = [(d, " ".join(w), "x", 1) for d, w in docs] + [(13, None, "x", 1), (4, " ".join(docs[3][1]), "y", 2)]
    out = P.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {d: t for d, t, *_ in rows}
    classes = [{1, 2, 3, None}, {5, 6}, {7, 8}]
    for r_ in out:
        assert any({r_.doc_id, r_.rep_doc_id} <= c for c in classes)
        mine, theirs = text[r_.doc_id].split()[r_.start : r_.end], text[r_.rep_doc_id].split()[r_.rep_start : r_.rep_end]
        assert len(mine) >= 50 and r_.similarity >= 0.8 and (mine == theirs) == (r_.similarity == 1)
    assert {x for r_ in out for x in (r_.doc_id, r_.rep_doc_id)} == set().union(*classes)
    assert P.near_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_in_documents_against_brute_force(spark):
    """Every document that shares a run of 50 words or more with another one is reported."""
    docs = {r.doc_id: r.text.lower().split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    seen: dict[tuple, set] = {}
    for d, w in docs.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    want = set().union(*(s for s in seen.values() if len(s) > 1))
    out = P.near_passages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    got = {x for r in out for x in (r.doc_id, r.rep_doc_id)}
    assert want <= got


def test_a_part_in_another_document_does_not_part_two(spark):
    """Sets of documents A and B that share 55 words, of which a third one has 30 to 52, before or behind a whole copy too: the passage is told of A with B, or of both with the third."""
    r = random.Random(11)
    rows, shared = [], []
    for k in range(60):
        p = words(r, 55)
        n = r.choice([30, 40, 45, 48, 52])
        at = r.randrange(56 - n)
        part = words(r, 80) + p[at : at + n] + words(r, 60)
        if k % 3 == 0:
            part += p + words(r, 20)
        docs = [words(r, r.randrange(80)) + p + words(r, r.randrange(80)) for _ in range(2)]
        docs.insert(0, part)
        shared.append((3 * k + 1, 3 * k + 2, set(p)))
        rows += [(3 * k + d, " ".join(w), "x", 1) for d, w in enumerate(docs)]
    text = {d: t.split() for d, t, *_ in rows}
    told = {}
    for x in P.near_passages(spark.createDataFrame(rows, SCHEMA)).collect():
        for d, e, i, j in ((x.doc_id, x.rep_doc_id, x.start, x.end), (x.rep_doc_id, x.doc_id, x.rep_start, x.rep_end)):
            told.setdefault((d, e), set()).update(text[d][i:j])
    for a, b, p in shared:
        assert p <= told.get((a, b), set()) | told.get((a, a - 1), set()) & told.get((b, a - 1), set()), (a, b)


def test_equal_passage_behind_a_partial_copy():
    r = random.Random(12)
    p = words(r, 55)
    a, b = p + words(r, 9), p[:30] + words(r, 70) + p
    assert [x[:4] for x in P.similar_stretches(a, b)] == [(0, 55, 100, 155)]


@pytest.mark.parametrize("length, changed, least", [(55, 1, 0.9), (60, 1, 0.92), (80, 1, 0.97), (120, 2, 0.97), (55, 0, 1.0)])
def test_recall_of_near_passages(spark, length, changed, least):
    """Pairs of documents whose only common passage has some words changed in one of them, so that its similarity is 0.8 to 0.95 (or 1)."""
    r, rows = random.Random(length), []
    for k in range(300):
        p = words(r, length)
        q = list(p)
        for i in range(changed):
            q[length * (i + 1) // (changed + 1) + r.randrange(-3, 4)] = "changed"
        x, y = ({tuple(t[i : i + 5]) for i in range(length - 4)} for t in (p, q))
        assert len(x & y) / len(x | y) >= 0.8
        rows += [(2 * k, " ".join(words(r, 40) + p + words(r, 30)), "", 0), (2 * k + 1, " ".join(words(r, 20) + q + words(r, 50)), "", 0)]
    found = {frozenset((x.doc_id, x.rep_doc_id)) for x in P.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found <= {frozenset((2 * k, 2 * k + 1)) for k in range(300)} and len(found) >= least * 300


@pytest.mark.parametrize("holders, same, least", [(1, True, 0.95), (4, False, 0.9)])
def test_recall_beside_documents_that_have_a_part(spark, holders, same, least):
    """Near pairs (80 words, one changed) beside third documents that hold a quarter of the passage: one, or one for each quarter."""
    r, rows = random.Random(holders), []
    for k in range(200):
        p = words(r, 80)
        q = [*p[:40], "changed", *p[41:]]
        docs = [words(r, 40) + p + words(r, 30), words(r, 20) + q + words(r, 50)]
        docs += [words(r, 60) + p[20 * h : 20 * h + 20] + words(r, 60) for h in ([r.randrange(4)] if same else range(holders))]
        rows += [(10 * k + d, " ".join(w), "", 0) for d, w in enumerate(docs)]
    found = {frozenset((x.doc_id, x.rep_doc_id)) for x in P.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len({f for f in found if {d % 10 for d in f} == {0, 1}}) >= least * 200


def test_recall_beside_many_documents_that_have_the_same_part(spark):
    """Near pairs (80 words, one changed) beside six documents that hold the same two halves of the passage, and so are the least and greatest text of its keys in half of the groups."""
    r, rows = random.Random(31), []
    for k in range(100):
        p = words(r, 80)
        q = [*p[:40], "changed", *p[41:]]
        docs = [words(r, 40) + p + words(r, 30), words(r, 20) + q + words(r, 50)]
        docs += [words(r, 60) + p[:40] + words(r, 60) + p[41:] + words(r, 20) for _ in range(6)]
        rows += [(10 * k + d, " ".join(w), "", 0) for d, w in enumerate(docs)]
    found = {frozenset((x.doc_id, x.rep_doc_id)) for x in P.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found <= {frozenset((10 * k, 10 * k + 1)) for k in range(100)} and len(found) >= 97


def test_common_lines_and_repeated_words_make_no_pairs(spark, monkeypatch):
    """Otherwise different documents that have the same two lines, and others where words are said again and again, are in the same keys and not compared with each other; a near pair among them is."""
    r, rows, pairs = random.Random(41), [], []
    one, two, near = words(r, 30), words(r, 30), words(r, 80)
    rows += [(d, " ".join(words(r, 60) + one + words(r, 90) + two + words(r, 60)), "", 0) for d in range(60)]
    rows += [(100 + d, " ".join(words(r, 60) + ["ha"] * r.randrange(30, 45) + words(r, 90) + ["ho", "hum"] * r.randrange(15, 20) + words(r, 60)), "", 0) for d in range(60)]
    rows += [(200 + k, " ".join(words(r, 20) + [*near[:40], *(["changed"] if k else near[40:41]), *near[41:]] + words(r, 20) + one + words(r, 30)), "", 0) for k in range(2)]
    old = P.parted
    monkeypatch.setattr(P, "parted", lambda *a: pairs.append(old(*a)) or pairs[-1])
    found = {frozenset((x.doc_id, x.rep_doc_id)) for x in P.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {frozenset((200, 201))} and pairs[0].count() <= 10


def test_similar_passages_share_a_run():
    """What RUN says: of passages that are told as similar, random edits or not, one run of RUN shingles or more is in both."""
    r, told = random.Random(17), 0
    for _ in range(3000):
        a = words(r, r.randrange(50, 160))
        b = list(a)
        for _ in range(r.randrange(1, 6)):
            i = r.randrange(len(b))
            b[i : i + r.choice([0, 1, 1, 3])] = words(r, r.randrange(3))
        runs = {tuple(b[i : i + P.RUN + 4]) for i in range(len(b) - P.RUN - 3)}
        for i, j, *_ in P.similar_stretches(a, b):
            told += 1
            assert any(tuple(a[k : k + P.RUN + 4]) in runs for k in range(i, j - P.RUN - 3))
    assert told > 1000


def test_copies_are_one_text(spark):
    r = random.Random(3)
    t, u = " ".join(words(r, 60)), " ".join(words(r, 20))
    rows = [(5, t, "", 0), (3, t, "", 0), (9, t, "", 0), (9, t, "", 0), (None, t, "", 0), (1, u, "", 0), (2, u, "", 0), (7, t + " tail", "", 0)]
    out = [tuple(x) for x in P.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(out) == 4 and {x for x in out if 7 not in (x[0], x[3])} == {(d, 0, 60, 3, 0, 60, 1.0) for d in (5, 9, None)}
    assert {x[0] for x in out if x[0] not in (3, 7)} == {5, 9, None} and {frozenset((x[0], x[3])) for x in out if 7 in (x[0], x[3])} == {frozenset((3, 7))}


def test_classes_of_documents(spark):
    found = spark.createDataFrame([(3, 2), (3, 2), (2, 9), (7, 8), (None, 1), (5, 5)], "doc_id long, rep_doc_id long")
    got = {(r.doc_id, r.class_id, r.n_links) for r in P.classes(found).collect()}
    assert got == {(2, 2, 2), (3, 2, 1), (9, 2, 1), (7, 7, 1), (8, 7, 1)}
    assert P.classes(found.limit(0)).count() == 0
