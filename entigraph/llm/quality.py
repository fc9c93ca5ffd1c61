"""A quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: four bytes of the text, and one to five signs of its outline. In the outline each run of letters
is one sign by its case (upper, lower, digits, other alphabets as lower), a word equal to the one before is `=`, and marks stand for themselves.
Each indicator is scaled by the log-ratio of its smoothed counts in the two classes; the counts are taken over all rows with a label. A linear model
of the scaled indicators, each text's vector of length 1, is fitted to the hinge loss by dual coordinate descent.

The fit uses a bounded part of the labelled rows, FIT_ROWS, chosen by hash, and is one descent over all of them in one task, whose size that bound
fixes. A logistic curve fitted to margins of all labelled rows, by a histogram of fixed size, makes margins scores.

Defined cases: a null text counts as empty, which has no features and gets the curve's value at the intercept; null labels and labels other than 0 and 1 are not learned
from; several labels of one doc_id count as several rows; with one class or none to learn from the score is that class (0.5 for none); a null doc_id is not held out; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import map_rows, stored, table

BITS = 17
DIM = 1 << BITS
#: At most so many labelled rows, those of the least hashes, are used for the hinge-loss fit.
FIT_ROWS = 6_000
SMOOTH, COST, ROUNDS = 1.0, 1.0, 8
THRESHOLD = 0.3
#: The curve's histogram: so many steps between margins -LIMIT and LIMIT.
STEPS, LIMIT = 400, 4.0

_LOWER, _UPPER, _DIGIT, _BLANK = b"a", b"A", b"0", b" "


def _signs() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = t[128:] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    t[[9, 11, 12, 13]] = ord(" ")
    return t


SIGNS = _signs()


def outline(b: np.ndarray) -> np.ndarray:
    s = SIGNS[b]
    blank = (s == 32) | (s == 10)
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(s) else np.zeros(0, np.int64)
    end = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1 if len(s) else start
    # a word's number: a polynomial of its bytes, by differences of a running sum
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | ((s[1:] != ord("a")) & (s[1:] != ord("A")) & (s[1:] != ord("0")) & (s[1:] != 32))
    if len(start) > 1:
        power = np.full(len(s) + 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + 1) * power[:-1])))
        word, size = run[end] - run[start], end - start
        # equal words at different places: compare after moving the earlier one to the later place
        same = np.concatenate(([False], (size[1:] == size[:-1]) & (word[:-1] * power[start[1:] - start[:-1]] == word[1:])))
        if same.any():
            s = s.copy()
            inside = np.zeros(len(s) + 1, np.int8)
            np.add.at(inside, start[same], 1)
            np.add.at(inside, end[same], -1)
            inside = np.cumsum(inside[:-1]) > 0
            s[start[same]] = ord("=")
            keep[inside] = False
            keep[start[same]] = True
    return s[keep]


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers, ascending."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    found = []
    if len(b) >= 4:
        x = b.astype(np.uint32)
        four = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
        found.append((four * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    if len(b):
        o = outline(b).astype(np.uint64)
        h = np.zeros(len(o), np.uint64)
        for n in range(1, 6):
            if len(o) < n:
                break
            h = h[: len(o) - n + 1] * np.uint64(257) + o[n - 1 :] + np.uint64(1)
            found.append((((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each feature the rows of label 0 and of label 1 that have it; the arrays have a fixed size, as has what comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, DIM), np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[y][features(t.as_py())] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0][at]), pa.array(n[1][at])], ["feature", "n0", "n1"])

    total = rows.select("text", "y").mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n = np.zeros((2, DIM))
    n[0][total.feature], n[1][total.feature] = total.n0, total.n1
    return n[0], n[1]


def log_ratio(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    p, q = n1 + SMOOTH, n0 + SMOOTH
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; classes weigh the same in all. Returns weights of scaled indicators and an intercept."""
    w, b = np.zeros(DIM), 0.0
    of = np.array([y for _, y in rows])
    weight = [cost * len(of) / (2 * max(1, (of == y).sum())) for y in (0, 1)]
    data = []
    for f, y in rows:
        x = ratio[f]
        size = np.sqrt(x @ x)
        data.append((f, x / size if size else x, 2.0 * y - 1, weight[y]))
    dual, order = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(data)):
            f, x, y, c = data[i]
            g = y * (w[f] @ x + b) - 1
            new = min(max(dual[i] - g / (x @ x + 1), 0.0), c)
            if step := (new - dual[i]) * y:
                w[f] += step * x
                b += step
                dual[i] = new
    return w, b


def fit(rows: DataFrame, ratio: np.ndarray, n_rows: int) -> tuple[np.ndarray, float]:
    """The descent over FIT_ROWS rows in a task of their own; what comes to the driver are DIM + 1 weights at most."""
    part = min(1.0, 1.2 * FIT_ROWS / max(1, n_rows))  # a coarse cut, so that few rows are sorted
    mixed = F.xxhash64("doc_id", "text", "y")
    chosen = rows.where(F.pmod(mixed, F.lit(1_000_003)) < part * 1_000_003).select(mixed.alias("h"), "text", "y").orderBy("h", "text", "y").limit(FIT_ROWS)

    def descent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(features(t.as_py()), y) for b in batches for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
        if data:
            w, b = descend(data, ratio)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*w[at].tolist(), b], pa.float64())], ["feature", "w"])

    # limit() leaves one partition, in order of the hash: the same descent whenever it is run again
    got = chosen.select("text", "y").mapInArrow(descent, "feature int, w double").toPandas()
    w = np.zeros(DIM + 1)
    w[got.feature] = got.w  # -1, the intercept, is the last
    return w[:-1], float(w[-1])


def margins(rows: DataFrame, ratio: np.ndarray, w: np.ndarray, b: float) -> DataFrame:
    """All columns of rows, with the text's margin in its place."""
    keep = [c for c in rows.columns if c != "text"]

    def make():
        def one(t: str | None) -> float:
            f = features(t)
            x = ratio[f]
            size = np.sqrt(x @ x)
            return float(w[f] @ x / size + b) if size else b

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            m = pa.array([one(t.as_py()) for t in batch.column(batch.schema.names.index("text"))], pa.float64())
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), m], [*keep, "margin"])

        return f

    return map_rows(rows, make, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), "margin double"]))


def curve(rows: DataFrame) -> tuple[float, float]:
    """(a, c) of 1 / (1 + exp(-(a * margin + c))) for rows (margin, y), by Newton steps over a histogram."""
    step = F.least(F.greatest(F.round((F.col("margin") + LIMIT) / (2 * LIMIT) * STEPS), F.lit(0)), F.lit(STEPS)).cast("int")
    h = rows.groupBy(step.alias("s"), "y").count().toPandas()
    m, y, n = h.s.to_numpy() / STEPS * 2 * LIMIT - LIMIT, h.y.to_numpy(float), h["count"].to_numpy(float)
    n1, n0 = n[y == 1].sum(), n[y == 0].sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, np.log((n1 + 1) / (n0 + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        g = np.array([(n * (p - goal) * m).sum(), (n * (p - goal)).sum()])
        v = n * p * (1 - p)
        move = np.linalg.solve(np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]]), g)
        move *= min(1.0, 5 / max(1e-12, np.abs(move).max()))
        a, c = a - move[0], c - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(c)


class Model:
    """What train() learned: fixed-size arrays."""

    def __init__(self, ratio, w, b, a, c) -> None:
        self.ratio, self.w, self.b, self.a, self.c = ratio, w, b, a, c


def train(rows: DataFrame) -> Model:
    """rows: doc_id, text, y; each with y of 0 or 1 is learned from."""
    rows = stored(rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("y").cast("int").alias("y")).where("y in (0, 1)"), "quality-rows")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    zero = np.zeros(DIM)
    if len(n) < 2:
        return Model(zero, zero, 0.0, 1.0, 0.0 if not n else 20.0 if 1 in n else -20.0)
    ratio = log_ratio(*class_counts(rows))
    w, b = fit(rows, ratio, sum(n.values()))
    return Model(ratio, w, b, *curve(margins(rows.select("text", "y"), ratio, w, b)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs but text, with score (0 to 1, higher: label 1 likelier)."""
    m = margins(docs.drop("margin", "score"), model.ratio, model.w, model.b)
    return m.withColumn("score", 1 / (1 + F.exp(-(F.lit(model.a) * F.col("margin") + F.lit(model.c))))).drop("margin")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where(~held_out() & F.col("y").isNotNull())
    # labels grow with the documents: a shuffled join at every size
    model = train(docs.where(~held_out()).join(labels.hint("merge"), "doc_id"))
    out = score(docs.withColumn("held_out", held_out()), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
