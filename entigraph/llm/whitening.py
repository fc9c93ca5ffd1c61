"""Embedding whitening by a weighted multiplicity covariance.

Vectors become whole numbers, x = floor(1024 * c) + 100000. Identical x are grouped first, with how many rows have each: these counts are the fit's weights (or one each, so that
copies don't pull the components towards themselves). The covariance is a product of weighted, centred matrices of distinct vectors, one for each task, summed by rows. Each distinct
vector is whitened once, and rows are joined back to theirs.

Vectors are centred at the whole numbers nearest to their means, so that products are exact in doubles and the order of tasks doesn't matter; the rest, below one half, is taken off
afterwards. Only sums, a matrix of dimension squared and the components come to the driver; MAX_DIM bounds their size.

Defined cases: null vectors, and those with a null or non-finite entry, are dropped; an entry beyond 2 ** 42 raises, as its x would not be exact; vectors of several lengths are fitted
and whitened by themselves, each length on its own, and one of no entries has no components; repeated rows, null ids and ties are rows like others; equal eigenvalues may give any unit
vectors of their space; a component without variance (an eigenvalue of at most NO_VARIANCE of the trace) is null whitened, and not part of the identity error; a deviation beyond a long
is null; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import stored, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: The sum of the lengths that vectors have, at most.
MAX_DIM = 4096
NO_VARIANCE = 1e-12
#: Vectors multiplied at once.
BLOCK = 4096


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with x, an array of long, in the vector's place; without those that have none."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) > 2.0**42, F.raise_error(F.lit("an entry is too large"))).otherwise(F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(fine).withColumn("x", F.transform(v, whole)).drop(*({vector} - {"x"}))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, w) of batches (x, w, ...) by length, a row a vector."""
    for batch in batches:
        x, w = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        size, flat = x.value_lengths().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        for d in np.unique(size[size > 0]):
            at = np.flatnonzero(size == d)
            for i in range(0, len(at), BLOCK):
                some = at[i : i + BLOCK]
                yield flat[start[some][:, None] + np.arange(d)], w[some]


def sums(distinct: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By length: the sum of weights, and that of weighted vectors."""

    def run(batches):
        n, s = defaultdict(int), {}
        for x, w in _blocks(batches):
            d = x.shape[1]
            n[d] += int(w.sum())
            s[d] = s.get(d, 0) + w @ x
        for d, v in s.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n[d]], pa.int64()), pa.array([v.tolist()], pa.list_(pa.int64()))], ["dim", "n", "s"])

    parts = distinct.select("x", "w").mapInArrow(run, "dim int, n long, s array<long>").select("dim", "n", F.posexplode("s").alias("i", "v"))
    got = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).limit(MAX_DIM + 1).collect()
    if len(got) > MAX_DIM:
        raise ValueError(f"vectors have more than {MAX_DIM} entries")
    out = {}
    for d in {r.dim for r in got}:
        rows = sorted((r.i, r.n, r.v) for r in got if r.dim == d)
        out[d] = rows[0][1], np.array([v for _, _, v in rows], np.int64)
    return out


class Fit:
    """Of vectors of one length: n, sums, the whole centre, what is left of the mean, components (a column each), eigenvalues and the trace."""

    def __init__(self, n: int, s: np.ndarray) -> None:
        self.n, self.s = n, s
        self.centre = np.array([(2 * int(v) + n) // (2 * n) for v in s], np.int64)
        self.left = np.array([int(v) - n * int(c) for v, c in zip(s, self.centre, strict=True)], np.int64)  # n times that

    def solve(self, products: np.ndarray, components: int) -> None:
        rest = self.left / self.n
        v = products / self.n - np.outer(rest, rest)
        e, p = np.linalg.eigh((v + v.T) / 2)
        k = min(components, len(e))
        self.e, self.p, self.trace = e[::-1][:k].copy(), p[:, ::-1][:, :k].copy(), float(np.trace(v))
        self.has = self.e > NO_VARIANCE * max(self.trace, 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.centre) - self.left / self.n) @ self.p
        return z / np.sqrt(np.where(self.has, self.e, np.nan))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = x - self.centre
        if float(((self.n * y.astype(float) - self.left) ** 2).sum(axis=1).max(initial=0)) < 4e18:
            return ((self.n * y - self.left) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.left.tolist(), strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _summed(parts: DataFrame) -> DataFrame:
    """(dim, i, row) with the rows of one (dim, i) added up: a task holds a part of one matrix, whatever the number of tasks before."""

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for d, i, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                total[d, i] = total.get((d, i), 0) + row.values.to_numpy()
        for (d, i), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["dim", "i", "row"])

    return parts.repartition("dim", "i").mapInArrow(run, "dim int, i int, row array<double>")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """By length, from distinct vectors (x, w)."""
    fits = {d: Fit(n, s) for d, (n, s) in sums(distinct).items()}

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for x, w in _blocks(batches):
            y = (x - fits[x.shape[1]].centre).astype(float)
            total[x.shape[1]] = total.get(x.shape[1], 0) + (y * w[:, None]).T @ y
        for d, g in total.items():
            for i, row in enumerate(g):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], ["dim", "i", "row"])

    got = defaultdict(dict)
    for r in _summed(distinct.select("x", "w").mapInArrow(run, "dim int, i int, row array<double>")).toPandas().itertuples():
        got[r.dim][r.i] = r.row
    for d, f in fits.items():
        f.solve(np.array([got[d][i] for i in range(d)]), components)
    return fits


def whitened(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """distinct (x, w) with deviation and z, the whitened components."""

    def run(batches):
        for x, w in _blocks(batches):
            f = fits[x.shape[1]]
            z = [[None if v != v else v for v in row] for row in f.whiten(x).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int64())), pa.array(w, pa.int64()), pa.array(f.deviation(x), pa.int64()), pa.array(z, pa.list_(pa.float64()))], ["x", "w", "deviation", "z"])

    return distinct.select("x", "w").mapInArrow(run, "x array<long>, w long, deviation long, z array<double>")


def identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length: the largest entry of the whitened vectors' covariance less the identity."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            size, w = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                z = np.nan_to_num(np.array(b.column(2).take(pa.array(at)).to_pylist(), float))
                one = np.hstack([np.ones((len(z), 1)), z])  # the first row and column are the sums
                total[d] = total.get(d, 0) + (one * w[at][:, None]).T @ one
        for d, m in total.items():
            for i, row in enumerate(m):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], ["dim", "i", "row"])

    parts = white.select(F.size("x").alias("dim"), "w", "z").mapInArrow(run, "dim int, i int, row array<double>")
    got = defaultdict(dict)
    for r in _summed(parts).toPandas().itertuples():
        got[r.dim][r.i] = r.row
    out = {}
    for d, f in fits.items():
        m = np.array([got[d][i] for i in range(len(f.e) + 1)]) / f.n
        v = (m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]))[f.has][:, f.has]
        out[d] = float(np.abs(v - np.eye(len(v))).max(initial=0.0))
    return out


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each vector and component. weights: counts, or one for each distinct vector."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    q = quantised(rows.select(F.col(key).alias("k"), F.col(vector).alias("v")), "v")
    distinct = stored(q.groupBy("x").agg(F.count("*").alias("w") if weights == "counts" else F.lit(1).cast("long").alias("w")), "whitening-distinct")
    fits = fit(distinct, components)
    white = stored(whitened(distinct, fits), "whitening")
    errors = identity_errors(white, fits) if fits else {}

    def by_length(of, kind):
        out = F.lit(None)
        for d, f in fits.items():
            out = F.when(F.size("x") == d, of(d, f)).otherwise(out)
        return out.cast(kind)

    share = by_length(lambda d, f: F.array(*[F.lit(float(e) / f.trace if f.trace > 0 else None).cast("double") for e in f.e]), "array<double>")
    back = q.select("k", "x", F.xxhash64("x").alias("h")).join(white.select("x", "deviation", "z", F.xxhash64("x").alias("h")), ["h", "x"])
    each = back.select("k", by_length(lambda d, f: F.lit(f.n), "long").alias("n"), "deviation", share.alias("share"), by_length(lambda d, f: F.lit(errors[d]), "double").alias("identity_error"), F.posexplode("z").alias("i", "whitened"))
    return each.select(F.col("k").alias(key), (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("share", "i").alias("explained"), "identity_error")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
