import random

import pytest

from entigraph.llm.repetition import PHRASE_LEAST, PHRASES, judged, measure, op7_repetition, repetition
from tests.llm.test_repetition import random_texts


def slow_phrases(text):
    words = text.split()
    n = len(words)
    places = {k: {} for k in PHRASES}
    for k, at in places.items():
        for i in range(n - k + 1):
            at.setdefault(tuple(words[i : i + k]), []).append(i)
    return tuple(max((len({j for i in s for j in range(i, i + k)}) for s in places[k].values() if len(s) >= PHRASE_LEAST), default=0) for k in PHRASES)


@pytest.mark.parametrize("seed", range(6))
def test_phrases_against_brute_force(seed):
    texts = random_texts(random.Random(seed))
    assert [m[9:-1] for m in measure(texts)] == [slow_phrases(t) for t in texts]


def test_the_method_alone_rejects(spark):
    """Repeats of two to seven words, none of the base rule's eight."""
    fresh = (f"w{i}" for i in range(10**6))

    def text(part, times, gap):
        return " ".join(w for _ in range(times) for w in [*part.split(), *(next(fresh) for _ in range(gap))])

    several = " ".join(text(f"a{k} b{k} c{k} d{k} e{k} f{k}", 2, 5) for k in range(10))
    rows = [(1, text("buy now", 30, 5)), (2, text("click here please", 30, 9)), (3, text("all rights are reserved", 30, 15)), (4, several), (5, text("buy now", 30, 20)), (6, text("alpha bravo charlie delta echoes foxtrot", 2, 10))]
    out = {r.doc_id: r for r in judged(repetition(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert not any(r.base_failed for r in out.values())
    assert {k: r.kept for k, r in out.items()} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_characters_decide_where_words_do_not(spark):
    """A sixth of the words in two copies, but long ones: over 30 % of the characters. With short ones the text stays."""
    rest = [f"w{i}" for i in range(50)]
    long, short = ([f"{c * n}{i}" for i in range(5)] for c, n in (("u", 9), ("v", 1)))
    rows = [(1, " ".join([*long, *rest, *long])), (2, " ".join([*short, *rest, *short]))]
    out = {r.doc_id: r for r in judged(repetition(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert not out[1].base_failed and out[1].n_covered_words == out[2].n_covered_words == 10
    assert (out[1].kept, out[2].kept) == (False, True)


def test_one_long_repeat_decides(spark):
    """An eighth of a text said twice: the base rule and the covered part let it pass."""
    fresh = [f"w{i:03}" for i in range(200)]
    rows = [(1, " ".join(fresh[:70] + fresh[:11])), (2, " ".join(fresh + fresh[:11])), (3, " ".join(fresh[:30] + fresh[:5]))]
    out = {r.doc_id: r for r in judged(repetition(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert not any(r.base_failed for r in out.values())
    assert {k: r.kept for k, r in out.items()} == {1: False, 2: True, 3: True}


def test_the_method_decides_documents_of_the_tables(spark):
    """The base rule lets these pass; none has a label that calls it good."""
    sf = "/root/testdata/sf0.1"
    out = op7_repetition(spark, sf).where("not base_failed and not kept").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(out) > 5 and not any(r.quality == 1 for r in out)
