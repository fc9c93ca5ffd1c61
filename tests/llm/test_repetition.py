import random
import re

import pytest

from entigraph.llm.repetition import MIN_REPEAT, judged, longest_repeats, measure, repetition


def slow(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    window = {}
    for i in range(n - 7):
        window.setdefault(tuple(words[i : i + 8]), []).append(i)
    in_window = {j for s in window.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
    cover = {j for i in range(n) if longest[i] >= MIN_REPEAT for j in range(i, i + longest[i])}
    chars = lambda at: sum(len(words[j]) for j in at)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if x.strip(" \t\n\x0b\f\r"):
            dup += x in seen
            seen.add(x)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(in_window), len(cover), chars(cover), max(longest, default=0), max((chars(range(i, i + k)) for i, k in enumerate(longest)), default=0)


def random_texts(r):
    out = []
    for _ in range(40):
        vocab = [f"w{i}" for i in range(r.choice([1, 2, 3, 30]))]
        words = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            words += words[r.randint(0, 20) :]
        out.append("".join(w + r.choice([" ", "\n", "  ", "# "]) for w in words))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    texts = random_texts(random.Random(seed))
    assert [m[:9] for m in measure(texts)] == [slow(t) for t in texts]


def test_empty_and_lone_words():
    assert measure(["", "a", "a a"])[0][:9] == (0,) * 9
    assert [m[7] for m in measure(["", "a", "a a"])] == [0, 0, 1]
    import numpy as np

    assert longest_repeats(np.array([], int), np.array([], int)).tolist() == []


def test_spans_join_maximal_repeats():
    part = " ".join(f"x{i}" for i in range(10))
    (m,) = measure([f"{part} a b {part} c"])
    assert m[-1] == [0, 10, 12, 22] and m[7:9] == (10, 20)


def test_rows_and_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(400))
    twice = " ".join(f"w{i}" for i in range(60))
    rows = [(1, clean, 3), (1, clean, 3), (2, None, None), (None, "", 1), (3, twice + " " + twice, 2), (4, clean + " " + " ".join(f"w{i}" for i in range(60)), 1), (5, "ha " * 50000, 1), (6, "a b c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    out = judged(repetition(docs)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert {k: r.kept for k, r in by.items()} == {1: True, 2: False, None: False, 3: False, 4: True, 5: False, 6: False}
    assert {k: (r.base_failed, r.repeats_failed) for k, r in by.items() if k in (1, 3, 4, 6)} == {1: (False, False), 3: (True, True), 4: (False, False), 6: (True, False)}
    assert by[5].longest_repeat == 49999 and by[6].base_failed and by[2].n_words == 0
    assert judged(repetition(docs.limit(0))).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 2500")
    got = {r.doc_id: tuple(r)[1:10] for r in repetition(docs).collect()}
    assert got == {r.doc_id: slow(r.text) for r in docs.collect()}
