import hashlib
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from entigraph.llm import bpe, simhash
from tests.llm.test_contamination import slow as slow_hits

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, d long, fp int, base string"
ROWS = [(1, "the end of it", "en", "s", 13, "x", 1, 1, "y")] * 2 + [(None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, None, 0, 0, ""), (3, "token=abcdefgh " + "word " * 20000, None, "s", 1, None, 0, 0, ""), (None, "der Hund", "de", "s", 8, "", 0, 0, "")]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edge_rows(spark, k):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = C.STAGES[k][1](spark, docs, SF)
    rows = out.collect()
    assert (k == 4) or tuple(out.columns) == C.COLUMNS
    assert len(rows) == [4, 4, 6, 6, 6][k]
    if k == 3:
        assert [r.text for r in rows if r.doc_id == 3][0].startswith("[SECRET] word")
    assert C.STAGES[k][1](spark, docs.limit(0), SF).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    left = {d: r.text for d, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    ids = sorted(left)
    fp = {d: simhash.fingerprint(left[d]) & (2**64 - 1) for d in ids}
    from tests.llm.test_simhash import roots

    root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    left = {d: left[d] for d in ids if root[d] == d}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_, c in slow_hits(list(left.items()), bench) if c}
    left = {d: t for d, t in left.items() if d not in bad}
    lib = Tokenizer.from_file(bpe.default_file())
    got = {r.doc_id: r.ids for r in C.run(spark, SF).collect()}
    assert got.keys() == left.keys() and len(left) < len(docs)
    for d, t in left.items():
        if not re.search(r"token|secret|passw|api_?key|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}", t, re.I):
            assert got[d] == lib.encode(t, add_special_tokens=False).ids
