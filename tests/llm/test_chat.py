import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from entigraph.llm import chat as C
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, n long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_examples_by_hand(spark):
    rows = [(1, 2, "assistant", "B", 0), (1, 0, "user", "a", 0), (1, 1, "assistant", "A", 0), (1, 3, "user", "z", 0)]
    out = C.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("target_no").collect()
    assert [(r.target_no, r.formatted[r.loss_start : r.loss_end] if r.loss_end else None) for r in out] == [(2, "A"), (3, "B"), (4, None)]
    assert out[0].formatted == "### user: a\n</turn>\n### assistant: A\n</turn>\n"
    assert out[2].formatted.startswith(out[1].formatted) and out[1].formatted.startswith(out[0].formatted)


def test_control_strings_and_edge_rows_round_trip(spark):
    texts = [None, "", C.FORGED, "\\", "\\\\###", "####\n</turn>\n### user: x", "\n</turn>\n", "</turn", "é🙂" * 3, "x" * 200_000, "\\</turn>\\n", ": ", "$1 \\1"]
    rows = [(5, i, ["user", "assistant", None, "odd: role\n###"][i % 4], t, 1) for i, t in enumerate(texts)]
    rows += [(None, None, "assistant", "x", 1), (None, None, "assistant", "x", 1), (6, 0, "user", "only", None)]
    made = C.examples(spark.createDataFrame(rows, SCHEMA))
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in made.groupBy("conv_id").agg(F.max_by("formatted", "target_no").alias("f")).select("conv_id", C.read(F.col("f")).alias("t")).collect()}
    assert back == {5: [(r or "", t or "") for _, _, r, t, _ in rows[: len(texts)]], None: [("assistant", "x")] * 2, 6: [("user", "only")]}
    out = {r.conv_id: r for r in C.conversation_digests(made).collect()}
    loss = "".join(t or "" for _, _, r, t, _ in rows[: len(texts)] if r == "assistant")
    assert (out[5].loss_sha256, out[5].loss_chars) == (sha(loss), len(loss))
    assert (out[6].loss_sha256, out[6].loss_chars, out[6].n_turns) == (sha(""), 0, 1)
    assert out[None].loss_sha256 == sha("xx")
    assert C.conversation_digests(C.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = db.execute(C.OP2_SQL).fetchall()
    assert sorted(map(tuple, C.op2_chat(spark, sf).collect())) == sorted(want)


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(alphabet="\\#</turn> \n:a", max_size=30), min_size=1, max_size=30))
def test_random_texts_round_trip(spark, texts):
    rows = [(1, i, "assistant", t, 0) for i, t in enumerate(texts)]
    (r,) = C.conversation_digests(C.examples(spark.createDataFrame(rows, SCHEMA))).collect()
    assert r.turns_sha256 == sha("".join(f"assistant\n{t}\n" for t in texts)) and r.loss_sha256 == sha("".join(texts))
