import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from entigraph.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, n string"


def brute(rows, weights="counts"):
    """(vec_id, component) -> values, in plain Python and one covariance over all rows."""
    kept = [(i, tuple(math.floor(1024 * c) + 100000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = defaultdict(list)
    for d in {len(x) for _, x in kept} - {0}:
        own = [(i, x) for i, x in kept if len(x) == d]
        listed = [x for _, x in own] if weights == "counts" else sorted({x for _, x in own})
        n, s = len(listed), [sum(c) for c in zip(*listed, strict=True)]
        m = np.array(listed, float) - np.array(s) / n
        v = m.T @ m / n
        e, p = np.linalg.eigh(v)
        e, p = e[::-1][:8], p[:, ::-1][:, :8]
        for i, x in own:
            far = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            z = (np.array(x) - np.array(s) / n) @ p
            for k in range(len(e)):
                out[i, k + 1].append((n, far, z[k] / math.sqrt(e[k]) if e[k] > 1e-9 else None, e[k] / np.trace(v) if np.trace(v) else None))
    return out


def same(got, want):
    """Components may have either sign, the same for all rows."""
    mine = defaultdict(list)
    for r in got:
        mine[r.vec_id, r.component].append((r.n, r.deviation, r.whitened, r.explained))
    assert Counter({k: len(v) for k, v in mine.items()}) == Counter({k: len(v) for k, v in want.items()})
    turn = {}
    none = lambda v: tuple(x is None for x in v)
    for k in sorted(want, key=str):
        for a, b in zip(sorted(mine[k], key=str), sorted(want[k], key=str), strict=True):
            assert a[:2] == b[:2] and none(a) == none(b)
            if b[2] is not None:
                if abs(b[2]) > 1e-3:
                    turn.setdefault(k[1], math.copysign(1, a[2] * b[2]))
                assert a[2] * turn.get(k[1], 1) == pytest.approx(b[2], abs=1e-6) and a[3] == pytest.approx(b[3], rel=1e-9)
    assert all(r.identity_error <= 1e-8 for r in got)


def made(count, dim, seed=1):
    r = np.random.default_rng(seed)
    v = (r.normal(size=(count, dim)) * np.linspace(1, 0.2, dim) / 4).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    return rows + [(count + i, rows[0][1]) for i in range(count // 2)]  # a third of all rows is one vector


@pytest.mark.parametrize("weights", ["counts", "one"])
@pytest.mark.parametrize("dim", [3, 12])
def test_same_as_brute_force(spark, dim, weights):
    rows = made(200, dim)
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(7)
    same(W.whiten(df, weights=weights).collect(), brute(rows, weights))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(50, 4)[:60] + [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [nan, 0.0, 0.0, 0.0]), (904, [0.0, -inf, 0.0, 0.0]), (None, [0.25, -0.5, 0.125, 0.0]), (905, [0.5, 1.0, -1.0, 2.0]), (905, [0.5, 1.0, -1.0, 2.0])]
    got = W.whiten(spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)).collect()
    same(got, brute(rows))
    assert sum(r.vec_id == 905 for r in got) == 8 and not {900, 901, 902, 903, 904} & {r.vec_id for r in got}


def test_several_lengths_and_no_variance(spark):
    rows = [(1, [0.5]), (2, [0.5]), (3, [1.0, 2.0]), (4, [2.0, 4.0]), (5, [3.0, 6.0])]
    got = {(r.vec_id, r.component): r for r in W.whiten(spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)).collect()}
    assert len(got) == 8 and got[1, 1].whitened is None and got[1, 1].explained is None and got[1, 1].n == 2 and got[1, 1].deviation == 0
    assert got[3, 2].whitened is None and abs(got[3, 1].whitened) == pytest.approx(math.sqrt(1.5)) and got[3, 1].n == 3
    assert got[3, 1].explained == pytest.approx(1) and got[3, 1].identity_error < 1e-9


def test_empty_table_and_large_entries(spark):
    df = spark.createDataFrame([(1, [1e20], None, None), (2, [0.0], None, None)], SCHEMA)
    out = W.whiten(df.limit(0))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    with pytest.raises(Exception, match="too large"):
        W.whiten(df).collect()
    far = W.whiten(spark.createDataFrame([(1, [4e12], None, None), (2, [-4e12], None, None)], SCHEMA)).collect()
    assert {r.deviation for r in far} == {None}


def test_query_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(W.op13_whitening(spark, sf).collect(), brute(rows))
