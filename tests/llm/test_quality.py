import math

import numpy as np
import pytest

from entigraph.llm import quality as Q

SCHEMA = "doc_id long, text string, y int, score double"


def test_outline_signs():
    o = lambda t: bytes(Q.outline(np.frombuffer(t.encode(), np.uint8))).decode()
    assert o("") == "" and o(" ") == " "
    assert o("Hello world! 42") == "Aa a! 0"
    assert o("ha ha ha") == "a = ="
    assert o("été ÉTÉ ab ab, ab,") == "a aAa a a, ="  # other alphabets count as lower
    assert o("x  y\n\nz") == "a a\n\na"


def test_descent_separates_and_matches_the_dual_optimum():
    r = np.random.default_rng(1)
    rows = [(np.unique(r.integers(0, 30, 8) + 40 * y), y) for y in r.integers(0, 2, 60).tolist()]
    w, b = Q.descend(rows, np.ones(Q.DIM), rounds=200)
    assert all((w[f].sum() / np.sqrt(len(f)) + b > 0) == (y == 1) for f, y in rows)

    def primal(w, b):
        of = np.array([y for _, y in rows])
        c = [len(of) / (2 * (of == y).sum()) for y in (0, 1)]
        return 0.5 * (w @ w + b * b) + sum(c[y] * max(0, 1 - (2 * y - 1) * (w[f].sum() / np.sqrt(len(f)) + b)) for f, y in rows)

    best = primal(w, b)
    for _ in range(200):  # no step in any direction is better
        d = r.normal(size=Q.DIM) * (w != 0) * 0.01
        assert primal(w + d, b + r.normal() * 0.01) > best - 1e-3


def test_counts_and_ratio(spark):
    rows = [(1, "abcd", 1, 0.0), (2, "abcd", 0, 0.0), (3, "abcd wxyz", 1, 0.0)]
    n0, n1 = Q.class_counts(spark.createDataFrame(rows, SCHEMA))
    f = Q.features("abcd")
    assert (n1[f] == 2).sum() >= 1 and n0[f].min() == 1
    assert Q.log_ratio(n0, n1)[n0 == 0].max() > 0


def test_edge_rows_and_single_class(spark):
    rows = [(1, "good text here", 1, 0.5), (1, "good text here", 1, 0.5), (None, None, 0, None), (2, "", None, None), (3, "BAD!! " * 30000, 0, 1.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = Q.score(docs, Q.train(docs)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {round(r.score) for r in Q.score(docs, Q.train(docs.where("y = 1"))).collect()} == {1}
    assert {r.score for r in Q.score(docs, Q.train(docs.limit(0))).collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.train(docs)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op3_quality(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.9


def slow_outline(b):
    sign = lambda x: "a" if 97 <= x <= 122 or x > 127 else "A" if 65 <= x <= 90 else "0" if 48 <= x <= 57 else " " if x in (9, 11, 12, 13, 32) else chr(x)
    out, words, at = [], [None], 0
    while at < len(b):
        end = at
        blank = sign(b[at]) in " \n"
        while end < len(b) and (sign(b[end]) in " \n") == blank:
            end += 1
        part = "".join(sign(x) for x in b[at:end])
        if not blank and b[at:end] == words[-1]:
            out.append("=")
        else:
            out += [c for i, c in enumerate(part) if i == 0 or c != part[i - 1] or c not in "aA0 "]
        if not blank:
            words.append(b[at:end])
        at = end
    return "".join(out)


def slow_features(text):
    b, out = (text or "").encode(), set()
    for i in range(len(b) - 3):
        out.add((int.from_bytes(b[i : i + 4], "little") * 2654435761) % 2**32 >> (32 - Q.BITS))
    o = slow_outline(b)
    for n in range(1, 6):
        for i in range(len(o) - n + 1):
            h = 0
            for c in o[i : i + n]:
                h = (h * 257 + ord(c) + 1) % 2**64
            out.add(((h + n) * 0x9E3779B97F4A7C15) % 2**64 >> (64 - Q.BITS))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "text", Q.F.col("quality").alias("y")).where("y is not null and length(text) < 6000")
    return rows.orderBy("doc_id").limit(60)


def test_features_against_brute_force(labelled):
    texts = ["", "a", "ab ab  ab\n\nab. AB1", "x" * 9, "été été ÉTÉ 🙂 9", "a\tb\x0bc", *[r.text[:1500] for r in labelled.limit(25).collect()]]
    for t in texts:
        assert set(Q.features(t).tolist()) == slow_features(t), t


def test_scores_against_brute_force(spark, labelled):
    """The whole operator in plain Python: counts, ratios, the descent over all rows in the order of their hash, and the curve as the best one."""
    rows = labelled.withColumn("h", Q.F.xxhash64("doc_id", "text", Q.F.col("y").cast("int"))).orderBy("h").collect()
    data = [(slow_features(r.text), r.y) for r in rows]
    n = {y: {} for y in (0, 1)}
    for f, y in data:
        for x in f:
            n[y][x] = n[y].get(x, 0) + 1
    total = {y: sum(c.values()) + Q.DIM * Q.SMOOTH for y, c in n.items()}
    ratio = lambda x: math.log((n[1].get(x, 0) + Q.SMOOTH) / total[1]) - math.log((n[0].get(x, 0) + Q.SMOOTH) / total[0])

    def vector(f):
        v = {x: ratio(x) for x in f}
        size = math.sqrt(sum(a * a for a in v.values()))
        return {x: a / size for x, a in v.items()}

    xs, w, b, dual = [vector(f) for f, _ in data], {}, 0.0, [0.0] * len(data)
    cost = {y: Q.COST * len(data) / (2 * sum(z == y for _, z in data)) for y in (0, 1)}
    order = np.random.default_rng(7)
    for _ in range(Q.ROUNDS):
        for i in order.permutation(len(data)).tolist():
            x, y = xs[i], data[i][1]
            g = (2 * y - 1) * (sum(a * w.get(k, 0.0) for k, a in x.items()) + b) - 1
            new = min(max(dual[i] - g / (sum(a * a for a in x.values()) + 1), 0.0), cost[y])
            step = (new - dual[i]) * (2 * y - 1)
            for k, a in x.items():
                w[k] = w.get(k, 0.0) + step * a
            b, dual[i] = b + step, new
    margin = [sum(a * w.get(k, 0.0) for k, a in x.items()) + b for x in xs]
    m = Q.train(labelled)
    got = {r.doc_id: r.score for r in Q.score(labelled, m).collect()}
    for r, z in zip(rows, margin, strict=True):
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-(m.a * z + m.c)))) < 1e-6
    # the curve: its loss over the margins, as the histogram rounds them, is the least
    n1, n0 = (sum(y == z for _, y in data) for z in (1, 0))

    def loss(a, c):
        out = 0.0
        for z, (_, y) in zip(margin, data, strict=True):
            p = 1 / (1 + math.exp(-(a * (round((z + Q.LIMIT) / (2 * Q.LIMIT) * Q.STEPS) / Q.STEPS * 2 * Q.LIMIT - Q.LIMIT) + c)))
            goal = (n1 + 1) / (n1 + 2) if y else 1 / (n0 + 2)
            out -= goal * math.log(p) + (1 - goal) * math.log(1 - p)
        return out

    best = loss(m.a, m.c)
    assert all(loss(m.a + i * 0.05, m.c + j * 0.05) >= best - 1e-9 for i in (-1, 0, 1) for j in (-1, 0, 1))
