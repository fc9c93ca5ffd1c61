"""Quality rules from repetition inside a text, by a suffix array over its words.

The suffix array of a text's words is built by doubling; the longest common prefixes of neighbours in it give the intervals of equal prefixes. The
longest repeat that starts at a word is the deepest interval that holds its suffix. Repeats of MIN_REPEAT words or more that cannot be extended to the
left are the maximal ones; the union of their spans is what the text repeats. A text fails if that union covers too large a part of its characters, or
if one repeat of LONG_REPEAT words or more alone is too large a part of them.

The base rule counts windows of eight words; these repeats begin at five and are measured in characters. Still shorter ones count as phrases: one of
two to four words that stands at least PHRASE_LEAST times in a text, its places an interval of the suffix array where neighbours have that many words
in common, must not cover too much of it either.

Texts of one Arrow batch are worked on together, in bounded groups, with a barrier between texts that no repeat crosses.

Defined cases: a null text has no words; a text of fewer than 20 words fails (base rule); repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import map_rows, table

#: Fixed values of the base rules.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: The method's repeats are so many words long at least; the largest part of a text's characters (those in words) that they may cover together. Five words are
#: the shortest of which the rules for web text of Gopher (Rae et al. 2021, table A1) count duplicates.
MIN_REPEAT, MAX_COVERED = 5, 0.30
#: The largest part that one repeat alone may have: with its copy that is a quarter of the text. Shorter ones, such as a title said twice, count together only.
LONG_REPEAT, MAX_LONGEST = 10, 0.125
#: The largest part of a text's words that one phrase of so many words may cover, of the same rules. One that stands there twice is no pattern.
PHRASES, PHRASE_LEAST = {2: 0.20, 3: 0.18, 4: 0.16}, 3
#: Words worked on at once; a longer text is a group of its own.
GROUP_WORDS = 120_000
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")


def ranks_by_doubling(word: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ; equal prefixes have the rank of their first place.

    word: numbers of words; left: words from here to the end of the text. A prefix that runs over that end is told apart by its length.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = word[order][1:] != word[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [rank], 1
    same = ~new
    same[:-1] |= ~new[1:]
    open_ = order[same]  # suffixes whose rank others share
    while len(open_):
        beyond = left[open_] <= k
        second = np.where(beyond, -left[open_] - 1, rank[np.minimum(open_ + k, n - 1)])
        # two suffixes of different texts that end here are equal so far: they stay apart only by their place
        second = np.where(beyond, -open_ - 1, second)
        first = rank[open_]
        at = np.lexsort((second, first))
        open_, first, second = open_[at], first[at], second[at]
        start = np.empty(len(open_), bool)
        start[0] = True
        start[1:] = first[1:] != first[:-1]
        new = start.copy()
        new[1:] |= second[1:] != second[:-1]
        place = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(start, place, 0))
        rank = rank.copy()
        rank[open_] = first + np.maximum.accumulate(np.where(new, place, 0)) - group
        levels.append(rank)
        same = ~new
        same[:-1] |= ~new[1:]
        open_ = open_[same]
        k *= 2
    return levels


def suffix_array(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' places in order, and of each two neighbours the words that they have in common.

    word: numbers of words, one at least; text: the number of each word's text, ascending.
    """
    n = len(word)
    ends = np.searchsorted(text, text, side="right")
    left = ends - np.arange(n)
    _, own = np.unique(text.astype(np.int64) << 32 | word.astype(np.int64), return_inverse=True)  # words of different texts differ
    levels = ranks_by_doubling(own, left)
    suffix = np.empty(n, np.int64)
    suffix[levels[-1]] = np.arange(n)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        k, rank = 1 << level, levels[level]
        fits = np.flatnonzero((left[np.minimum(a, n - 1)] >= k) & (left[np.minimum(b, n - 1)] >= k) & (a < n) & (b < n))
        fits = fits[(rank[a[fits]] == rank[b[fits]]) & (text[a[fits]] == text[suffix[fits]])]
        common[fits] += k
        a[fits] += k
        b[fits] += k
    return suffix, common


def longest_repeats(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place, the words of the longest repeat in its own text that starts there: its suffix's deepest interval of common prefixes.

    word: numbers of words; text: the number of each word's text, ascending. Occurrences may overlap.
    """
    return _longest(*suffix_array(word, text)) if len(word) else np.zeros(0, np.int64)


def _longest(suffix: np.ndarray, common: np.ndarray) -> np.ndarray:
    out = np.zeros(len(suffix), np.int64)
    out[suffix[:-1]] = common
    np.maximum.at(out, suffix[1:], common)
    return out


def phrase_cover(suffix: np.ndarray, common: np.ndarray, text: np.ndarray, size: int, texts: int) -> np.ndarray:
    """For each of so many texts, the most words that one phrase of `size` words covers which stands there PHRASE_LEAST times or more."""
    out = np.zeros(texts, np.int64)
    group = np.concatenate(([0], np.cumsum(common < size)))  # suffixes that begin with the same phrase
    many = np.bincount(group)[group] >= PHRASE_LEAST
    group, place = group[many], suffix[many]
    if len(group):
        order = np.lexsort((place, group))
        group, place = group[order], place[order]
        words = np.full(len(group), size, np.int64)
        words[:-1] = np.where(group[1:] == group[:-1], np.minimum(np.diff(place), size), size)
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        np.maximum.at(out, text[place[start]], np.add.reduceat(words, start))
    return out


def covered(longest: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Whether each word lies in a repeat of at least so many words; span: count only so many words from each start."""
    n = len(longest)
    start = np.flatnonzero(longest >= least)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + (longest[start] if span is None else span), n), -1)
    return np.cumsum(step[:-1]) > 0


def _numbers(words: list[str]) -> list[int]:
    seen: dict[str, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "n_covered_chars", "longest_repeat", "longest_repeat_chars", *(f"n_phrase{k}_words" for k in PHRASES)]


def measure(texts: list[str]) -> list[tuple]:
    """Per text the measures of NAMES, then the spans [start, end, start, end ...] in words of all repeats of MIN_REPEAT words or more."""
    out: list[tuple] = []
    group: list[tuple[list[int], list[int], list[int]]] = []  # a text's words by number, their lengths, and its base counts
    size = 0

    def flush() -> None:
        counts = np.array([len(ids) for ids, *_ in group], np.int64)
        word = np.fromiter((i for ids, *_ in group for i in ids), np.int64, int(counts.sum()))
        chars = np.concatenate(([0], np.cumsum(np.fromiter((n for _, sizes, _ in group for n in sizes), np.int64, len(word)))))
        text = np.repeat(np.arange(len(group)), counts)
        suffix, common = suffix_array(word, text) if len(word) else (word, word)
        longest = _longest(suffix, common) if len(word) else word
        phrases = [phrase_cover(suffix, common, text, k, len(group)) if len(word) else np.zeros(len(group), np.int64) for k in PHRASES]
        windows, all_ = covered(longest, WINDOW, WINDOW), covered(longest, MIN_REPEAT)
        covered_chars = np.concatenate(([0], np.cumsum(np.where(all_, np.diff(chars), 0))))
        repeat_chars = chars[np.arange(len(word)) + longest] - chars[:-1]
        at = 0
        for (_, _, base), n, *most in zip(group, counts.tolist(), *(p.tolist() for p in phrases), strict=True):
            here = all_[at : at + n]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], here.view(np.int8), [0]))))
            top, top_chars = (int(longest[at : at + n].max()), int(repeat_chars[at : at + n].max())) if n else (0, 0)
            out.append((n, *base, int(windows[at : at + n].sum()), int(here.sum()), int(covered_chars[at + n] - covered_chars[at]), top, top_chars, *most, edge.tolist()))
            at += n
        group.clear()

    for t in texts:
        words = _WORD.findall(t)
        lines = [x for x in t.split("\n") if _WORD.search(x)]
        if size + len(words) > GROUP_WORDS and group:
            flush()
            size = 0
        sizes = list(map(len, words))
        group.append((_numbers(words), sizes, [sum(sizes), len(_SYMBOL.findall(t)), len(lines) - len(set(lines))]))
        size += len(words)
    if group:
        flush()
    return out


def repetition(docs: DataFrame) -> DataFrame:
    """docs' doc_id with the measures of its text (NAMES, all long) and spans, the union of the repeats as array<int>: start, end, start, end ... in words."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = measure([t or "" for t in batch.column(1).to_pylist()])
            cols = [batch.column(0), *(pa.array([r[i] for r in got], pa.int64()) for i in range(len(NAMES))), pa.array([r[-1] for r in got], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *NAMES, "spans"])

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", spans array<int>")


def judged(measures: DataFrame, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """measures with base_failed, repeats_failed (the method's verdict), and kept: neither."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.col("n_covered_chars") > max_covered * F.col("word_chars")
    failed |= (F.col("longest_repeat") >= LONG_REPEAT) & (F.col("longest_repeat_chars") > max_longest * F.col("word_chars"))
    for k, most in PHRASES.items():
        failed |= F.col(f"n_phrase{k}_words") > most * F.col("n_words")
    return measures.withColumns({"base_failed": base, "repeats_failed": failed, "kept": ~base & ~failed})


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(repetition(table(spark, sf_dir, "documents"))).drop("spans")
