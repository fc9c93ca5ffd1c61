import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from entigraph.llm.bpe import Encoder, decode, default_file, digests, encode

LIB, OWN = Tokenizer.from_file(default_file()), Encoder(default_file())


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", ["", " ", "Hello world", "a  b", " a\n b\n\n c ", "a \nb", "tab\there\x0b\x0c x", "it's 're we'll  'd", "aaaaaaaaaaaaaaaa" * 50, "éèñ ß 漢字 🙂🙂", "x<|endoftext|> y<|endoftext|>", "12345 6.7 z q\x1c\x1d w", "́ é", " " * 900 + "x", "ab" * 5000, "İstanbul ΑΣ ΣΑ."])
def test_same_ids_and_text_as_the_library(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert OWN.decode(want) == LIB.decode(want, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabetsin'.,0123<|>éß"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=60))
def test_same_ids_on_random_texts(text):
    assert ids(text) == LIB.encode(text, add_special_tokens=False).ids


def test_same_ids_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in encode(docs).collect()}
    want = dict(zip(texts, LIB.encode_batch(list(texts.values()), add_special_tokens=False), strict=True))
    assert got == {k: v.ids for k, v in want.items()}


def test_decode_and_digests_with_edge_rows(spark):
    rows = [(1, "a b\n", "x"), (1, "a b\n", "y"), (None, None, "z"), (2, "", None), (3, "é" * 70000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = encode(docs)
    assert sorted((r.doc_id or 0, r.text) for r in decode(tokens).collect()) == sorted((a or 0, b or "") for a, b, _ in rows)
    out = {r.doc_id: r for r in digests(tokens).collect()}
    for key, text, _ in rows:
        want = np.array(LIB.encode(text or "", add_special_tokens=False).ids, "<u4")
        assert out[key].n_tokens == len(want)
        assert out[key].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert out[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert digests(encode(docs.limit(0))).count() == 0
