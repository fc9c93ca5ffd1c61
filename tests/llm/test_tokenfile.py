import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from entigraph.llm import tokenfile as tf

LIB, OWN = Tokenizer.from_file(tf.default_file()), tf.WordEncoder(tf.default_file())
SCHEMA = "doc_id long, text string, ids string, part string"


@pytest.mark.parametrize("text", ["", " ", "Hello, World's  x\n\ny", "É é ΑΣ ΣΑ. İ", "a\x1cb\x85c d", "x<|endoftext|>y <|startoftext|>", "ﬁ ½ 漢字🙂 12a3", " ́x", " a b"])
def test_word_encoder_is_the_library(text):
    got = np.frombuffer(tf.WordEncoder(tf.default_file()).encode([text])[0], "<u2").tolist()
    assert got == LIB.encode(text, add_special_tokens=False).ids


def hashed(text):
    """The order of rows of one doc_id: Spark's hash of a string is this with seed 42, signed."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return (h - 2**64 if h >= 2**63 else h) % (1 << 20), text or ""


def expected(rows):
    rows, start, out = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]))), 0, []
    for d, t, *_ in rows:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, tf.END_ID]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, path):
    got = tf.with_starts(spark, path, tf.read_tokens(spark, path).drop("ids")).orderBy("start").collect()
    return [(r.doc_id, r.start, r.n_tokens, r.crc32) for r in got]


def test_round_trip_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = f"file://{tmp_path}/t"
    tf.write_tokens(docs, path, parts=5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert read(spark, path) == expected(rows)
    d, t = rows[17]
    assert tf.read_one(spark, path, d) == [[*LIB.encode(t, add_special_tokens=False).ids, tf.END_ID]]


def test_edge_rows(spark, tmp_path):
    rows = [(4, "b", "x", "y"), (4, "b", "x", "y"), (4, "a", "x", "y"), (None, "null id", None, None), (2, None, None, None), (9, "word " * 30000, None, None), (1, "", None, None)]
    path = f"file://{tmp_path}/t"
    tf.write_tokens(spark.createDataFrame(rows, SCHEMA), path, parts=3)
    assert read(spark, path) == expected(rows)
    assert len(tf.read_one(spark, path, 4)) == 3
    empty = f"file://{tmp_path}/e"
    tf.write_tokens(spark.createDataFrame([], SCHEMA), empty)
    assert read(spark, empty) == []


def test_wrong_dictionary_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tf.write_tokens(spark.createDataFrame([(1, "a b", "", "")], SCHEMA), path)
    with pytest.raises(ValueError, match="hash"):
        tf._opener("0" * 64, tf.read_dictionary(spark, path)[2])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tABetsin'.,0123<|>éßΣİ́"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=60))
def test_word_encoder_on_random_texts(text):
    assert np.frombuffer(OWN.encode([text])[0], "<u2").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_a_doc_id_with_most_rows_fills_several_parts(spark, tmp_path):
    """A third of the rows has one doc_id, another third none."""
    r = np.random.default_rng(3)
    rows = [(d, f"text {k} {r.integers(10**9)}", "", "") for k, d in enumerate([7] * 60 + [None] * 60 + list(range(60)))]
    path = f"file://{tmp_path}/t"
    tf.write_tokens(spark.createDataFrame(rows, SCHEMA), path, parts=12)
    assert read(spark, path) == expected(rows)
    parts = tf.read_blocks(spark, path).select("part", tf.F.explode("doc_ids").alias("d")).groupBy(tf.F.coalesce("d", tf.F.lit(-1)).alias("d")).agg(tf.F.countDistinct("part").alias("n")).collect()
    assert {x.d: x.n > 2 for x in parts if x.d in (7, -1)} == {7: True, -1: True}


@given(st.lists(st.integers(0, 9), min_size=1, max_size=20), st.integers(-1, 10))
@settings(max_examples=20, deadline=None)
def test_binary_search(spark, bounds, d):
    bounds = sorted(bounds)
    at = spark.range(1).select(tf._place(bounds, tf.F.lit(d).cast("long"), False), tf._place(bounds, tf.F.lit(d).cast("long"), True)).first()
    assert tuple(at) == (sum(b < d for b in bounds), sum(b <= d for b in bounds))
