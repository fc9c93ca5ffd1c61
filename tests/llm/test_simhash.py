import random

import pytest

from entigraph.llm.components import components
from entigraph.llm.simhash import fingerprint, fingerprints, links, near_duplicates

SCHEMA = "doc_id long, text string, lang string, fp string"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_chain_star_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    want = roots({n for p in pairs for n in p}, pairs)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("spread", [3, 9])
def test_links_against_brute_force(spark, spread):
    """Many fingerprints round few centres, so that buckets are small, and large enough to be indexed again."""
    r = random.Random(spread)
    fps = {0, -1}
    for centre in [r.getrandbits(63) - 2**62 for _ in range(4)]:
        for _ in range(300):
            x = centre
            for _ in range(r.randint(0, 3)):
                x ^= 1 << (r.randrange(spread) + r.choice((0, 32)))
            fps.add(x)
        fps.update((centre ^ 1 << b) for b in range(40))
    fps = sorted(fps)
    got = {r.node: r.root for r in components(links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    want = roots(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2])
    assert {x: got.get(x, x) for x in fps} == want


def test_fingerprint_words_and_case(spark):
    import xxhash

    assert fingerprint(None) == fingerprint("") == fingerprint(" \n\t") == 0
    one = xxhash.xxh64_intdigest("ab É".encode(), 42)
    assert fingerprint("  AB\tÉ ") & (2**64 - 1) == one
    assert fingerprint("a b") == fingerprint("A B") != fingerprint("a b")


def test_near_duplicates_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(500))
    rows = [(5, base, "en", "x"), (5, base, "en", "x"), (3, base + " more", None, None), (9, None, None, None), (8, "", None, None), (None, " ", None, None), (2, "alone here now", "en", "y"), (7, "x " * 20000, "en", "y")]
    out = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    near = bin((fingerprint(base) ^ fingerprint(base + " more")) & (2**64 - 1)).count("1") <= 2
    assert out == {(5, 3 if near else 5), (3, 3), (9, 8), (8, 8), (None, 8), (2, 2), (7, 7)}
    assert near_duplicates(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sf_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fp = {r.doc_id: r.fp for r in fingerprints(docs).collect()}
    ids = sorted(fp)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin((fp[a] ^ fp[b]) & (2**64 - 1)).count("1") <= 2])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want
