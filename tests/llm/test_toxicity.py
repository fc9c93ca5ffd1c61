import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entigraph.llm import toxicity as T

SCHEMA = "doc_id long, text string, y int, words string, score string"


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


TERMS = ("abba", "abbaba", "baabbaab", "cab", "abcabcabc", "é")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcé😀", max_size=11), min_size=1, max_size=12))
def test_automaton_is_the_edit_distance(words):
    want = [min(((d, i) for i, t in enumerate(TERMS) if (d := edits(t, w)) <= T.allowed(t)), default=None) for w in words]
    assert T.automaton(TERMS).run(words) == want


def test_automaton_starts_again_when_full(monkeypatch):
    monkeypatch.setattr(T, "MAX_STATES", 3)
    a = T.Automaton(TERMS)
    for w in ("abba", "abb", "cab", "cb", "baabbaabxx"):
        assert a.run([w]) == T.automaton(TERMS).run([w])


def test_matches_spans_and_windows():
    f = T.Finder(("idiot", "worthless"))
    text = 'They said "you Idi0t there" and left. WORTLESS; w0rthlesss'
    n, got = f.find([text])[0]
    assert n == 9 and [(text[a:b], t, d, q) for a, b, t, d, q, _ in got] == [("Idi0t", "idiot", 1, True), ("WORTLESS", "worthless", 1, False), ("w0rthlesss", "worthless", 2, False)]
    assert got[0][5] == ["they", "said", "you", "there", "and", "left", "wortless"]
    assert f.find(["", "none here", "id*ot"])[2][1][0][:4] == (0, 5, "idiot", 1)


@pytest.mark.parametrize("text, inside", [('a "x X x" b', True), ('"a" X "b"', False), ("« X »", True), ("« a » X « b »", False), ("„a X b“", True), ("“X”", True), ("X", False), ('"X', False)])
def test_quotation(text, inside):
    assert T.quoted(text, text.index("X"), text.index("X") + 1) == inside


def test_pieces_do_not_change_matches():
    r = random.Random(3)
    text = " ".join(r.choice(["idiot", "idot", "plain", "words", '"', "x" * 50]) for _ in range(3000))
    whole = T.Finder(("idiot",)).find([text, "", text])
    assert T.Finder(("idiot",), piece=37).find([text, "", text]) == whole and len(whole[0][1]) > 500


def made(n, seed=5):
    """Toxic rows throw one of four words at someone; half of the others report them."""
    r = random.Random(seed)
    terms, plain = ["worthless", "pathetic", "moron", "scum"], [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        y, w = int(i % 4 == 0), r.choices(plain, k=40)
        if y:
            for _ in range(2):
                w.insert(r.randrange(40), f"you {r.choice(terms)}")
        elif i % 4 == 1:
            w.insert(r.randrange(40), f'the report quotes "{r.choice(terms)}" as wording')
        rows.append((i, " ".join(w), y, "a", "b"))
    return rows


def test_quotation_is_told_from_abuse(spark):
    model = T.train(spark.createDataFrame(made(1200), SCHEMA))
    assert set(model.terms) & {"worthless", "pathetic", "moron", "scum"}
    again = made(400, seed=9)
    got = {r.doc_id: r.score for r in T.score(spark.createDataFrame(again, SCHEMA), model).collect()}
    wrong = sum((got[i] >= T.THRESHOLD) != y for i, _, y, *_ in again)
    assert wrong <= 4
    plain = "word1 word2 word3 word4 word5 word6 "
    ask = [(1, plain + "you worthles and you patetic thing " + plain, 0), (2, plain + 'the report quotes "worthless" as wording ' + plain, 0), (3, plain * 5, 0)]
    got = {r.doc_id: r.score for r in T.score(spark.createDataFrame([(*a, "", "") for a in ask], SCHEMA), model).collect()}
    assert got[1] > 0.7 > 0.3 > got[2] and got[3] < 0.3


def test_lexicon_counts_are_those_of_all_rows(spark):
    rows = made(800)
    terms = T.lexicon(spark.createDataFrame(rows, SCHEMA).repartition(5), 600, 200)
    assert terms
    for t, n in terms.items():
        assert n == tuple(sum(y == k and t in {m.lower() for m in T.TOKEN.findall(x)} for _, x, y, *_ in rows) for k in (0, 1))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "", ""), (None, "", 0, None, None), (2, "same text", 1, "", ""), (2, "same text", 1, "", ""), (3, "idiot " * 60_000, 0, "", ""), (4, "x" * 300_000, None, "", "")], SCHEMA)
    out = T.score(docs, T.train(docs)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert out[0].asDict().keys() == {"doc_id", "y", "words", "score"}
    assert {r.score for r in T.score(docs, T.train(docs.where("y = 1"))).collect()} == {1.0}
    assert {r.score for r in T.score(docs, T.train(docs.limit(0))).collect()} == {0.5}
    assert T.score(docs.limit(0), T.train(docs)).count() == 0
    found = T.find(docs, ("idiot",), piece=1000).select("doc_id", "y", "words", "matches").collect()
    assert {len(r.matches) for r in found} == {0, 60_000}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = T.op11_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    # a twelfth of the rows of bad quality are toxic by chance there, and nothing in them tells it
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality = 1").collect()
    toxic, other = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 100 and np.mean([r.predicted for r in toxic]) > 0.9 and np.mean([r.predicted for r in other]) < 0.01
