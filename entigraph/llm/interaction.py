"""Filter interaction audit: what each filter removes in every order of the filters, alone, in vain and at what cost.

Texts are measured by a table-driven transducer over their UTF-8 bytes, in one pass. It has two states, between words and in a word; the next byte's class and the state say what to count
(a word's beginning, a capital, a code point, a symbol) and the next state. The state depends on the last byte's class alone, so the steps of a piece are looked up at once. Spans of words go
into a hash table with open addressing, by a rolling hash of their bytes; a span is taken for one that is there only if its bytes are the same. What is left are the distinct words.

A row's failures are bits. Rows are counted by part and failures (2 ** filters cells a part at most), and all orders are worked out from the cells: what an order's step removes depends on
which filters stand before it, not on their order, so each (filter, filters before) is summed once.

Defined cases: a null text is an empty one and a null source the part of empty name; an empty text fails A only (and E after another one); rows with one doc_id are rows of their own, and
of equal texts all rows with the smallest doc_id pass E; a null doc_id is never larger or smaller than another, and has no label; several labels of a doc_id count if one of them is 1;
texts are read in pieces cut between words, so a long one costs the memory of its distinct words; columns besides those named are not read; an empty table has no parts and no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import map_rows, stored, table

BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#$%&*|"
#: Bytes of a piece: whole texts, or a part of a long one.
PIECE = 1 << 20
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")
#: More filters have too many orders to list.
MAX_FILTERS = 6

BLANK, CAPITAL, SYMBOL, INSIDE, OTHER = range(5)
BETWEEN, WORD = range(2)
_BEGINS, _IS_CAPITAL, _IS_POINT, _IS_SYMBOL = 1, 2, 4, 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[byte], the state; emit[state, byte], what is counted."""
    kind = np.full(256, OTHER, np.uint8)
    kind[list(BLANKS)], kind[list(SYMBOLS)] = BLANK, SYMBOL
    kind[ord("A") : ord("Z") + 1] = CAPITAL
    kind[0x80:0xC0] = INSIDE  # of a code point
    after = np.where(kind == BLANK, BETWEEN, WORD).astype(np.uint8)
    emit = np.where(kind == INSIDE, 0, _IS_POINT) | np.where(kind == CAPITAL, _IS_CAPITAL, 0) | np.where(kind == SYMBOL, _IS_SYMBOL, 0)
    return after, np.stack([emit | np.where(after == WORD, _BEGINS, 0), emit]).astype(np.uint8).ravel()


NEXT, EMIT = _tables()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash's base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(max(n, PIECE + 1), base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_POWERS = _Powers()


def _same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    along = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.logical_and.reduceat(buf[np.repeat(a, size) + along] == buf[np.repeat(b, size) + along], first)


class Words:
    """A hash table of distinct (text, word), words as spans of a buffer."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf, self.slots = buf, np.full(64, -1, np.int64)
        self.start = self.size = self.text = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)

    def _place(self, todo: np.ndarray) -> np.ndarray:
        """Puts words into the slots; those of them that were not there."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (self.hash[todo] >> np.uint64(20)) & mask
        new = []
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free][::-1]] = todo[free][::-1]  # the first of several is the last to be written
            there = self.slots[slot]
            mine = there == todo
            same = ~mine & (self.hash[there] == self.hash[todo]) & (self.size[there] == self.size[todo]) & (self.text[there] == self.text[todo])
            if same.any():
                same[same] = _same_bytes(self.buf, self.start[there[same]], self.start[todo[same]], self.size[todo[same]])
            new.append(todo[mine])
            left = ~mine & ~same
            todo, slot = todo[left], (slot[left] + np.uint64(1)) & mask
        return np.sort(np.concatenate(new)) if new else todo

    def insert(self, start: np.ndarray, size: np.ndarray, text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The texts of those words that were not there, one for each."""
        had, many = len(self.start), len(self.start) + len(start)
        if 2 * many > len(self.slots):
            self.slots = np.full(1 << (2 * many).bit_length(), -1, np.int64)
            self._place(np.arange(had))
        hashes = (hashes ^ text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(_BASE)
        self.start, self.size, self.text, self.hash = (np.concatenate(x) for x in ((self.start, start), (self.size, size), (self.text, text), (self.hash, hashes)))
        new = self._place(np.arange(had, many))
        used = self.slots >= had
        self.slots[used] = had + np.searchsorted(new, self.slots[used])
        keep = np.concatenate((np.arange(had), new))
        found = self.text[new]
        self.start, self.size, self.text, self.hash = self.start[keep], self.size[keep], self.text[keep], self.hash[keep]
        return found


def _cuts(buf: np.ndarray, start: int, end: int, piece: int) -> list[tuple[int, int]]:
    """The pieces of a text: each but the last ends after a blank, so no word is in two."""
    out = []
    while end - start > piece:
        at = start + piece
        back = np.flatnonzero(NEXT[buf[start:at]] == BETWEEN)
        if len(back):
            at = start + int(back[-1]) + 1
        else:  # a word longer than a piece
            while at < end:
                ahead = np.flatnonzero(NEXT[buf[at : min(at + piece, end)]] == BETWEEN)
                if len(ahead):
                    at += int(ahead[0]) + 1
                    break
                at = min(end, at + piece)
        out.append((start, at))
        start = at
    return [*out, (start, end)] if end > start or not out else out


def measured(buf: np.ndarray, bounds: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """MEASURES (columns) of the texts (rows) between bounds in a buffer of bytes."""
    out, first, n = np.zeros((len(bounds) - 1, len(MEASURES)), np.int64), 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + piece, "right")) - 1)
        last = min(last, n)
        words = Words(buf)
        one = last == first + 1
        for a, b in _cuts(buf, int(bounds[first]), int(bounds[last]), piece) if one else [(int(bounds[first]), int(bounds[last]))]:
            edges = np.array([a, b]) if one else bounds[first : last + 1]
            out[first:last] += _pass(buf[a:b], a, edges - a, words)
        first = last
    return out


def _pass(b: np.ndarray, offset: int, edges: np.ndarray, words: Words) -> np.ndarray:
    """The transducer's run over one piece, in which texts end at edges."""
    out = np.zeros((len(edges) - 1, len(MEASURES)), np.int64)
    if not len(b):
        return out
    after = NEXT[b]
    before = np.empty_like(after)
    before[1:], before[0] = after[:-1], BETWEEN
    begins = edges[:-1][edges[:-1] < len(b)]
    before[begins] = BETWEEN
    got = EMIT[before.astype(np.uint16) << 8 | b]
    ends = np.zeros(len(b), bool)
    ends[:-1] = (after[:-1] == WORD) & (after[1:] == BETWEEN)
    close = edges[1:][edges[1:] > 0] - 1
    ends[close] |= after[close] == WORD
    start, end = np.flatnonzero(got & _BEGINS), np.flatnonzero(ends) + 1
    text = np.searchsorted(edges, start, "right") - 1
    up, down = _POWERS.of(len(b) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
    new = words.insert(start + offset, end - start, text, (run[end] - run[start]) * down[start])
    many = len(edges) - 1
    out[:, 0], out[:, 1] = np.bincount(text, minlength=many), np.bincount(new, minlength=many)
    for column, bit in ((2, _IS_CAPITAL), (3, _IS_POINT), (4, _IS_SYMBOL)):
        out[:, column] = np.diff(np.searchsorted(np.flatnonzero(got & bit), edges))
    return out


def measure(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """All columns of docs but text, with MEASURES of it."""
    docs = docs.drop(*MEASURES).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    keep = [c for c in docs.columns if c != "text"]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            t = batch.column(batch.schema.names.index("text"))
            offsets = np.frombuffer(t.buffers()[1], np.int64 if pa.types.is_large_binary(t.type) else np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64)
            data = t.buffers()[2]
            got = measured(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets, piece)
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), *(pa.array(c) for c in got.T)], [*keep, *MEASURES])

        return f

    return map_rows(docs, make, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), *(f"{m} long" for m in MEASURES)]))


#: What fails a row, in order of the bits, over MEASURES and `repeated`.
FILTERS: dict[str, Column | str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "n_symbols > 0",
    "E": "repeated",
}


def failures(docs: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text, part) as (doc_id, part, fails): the bits of the filters that a row fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), "text")
    rows = stored(measure(rows), "audit-measures")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = stored(groups, "audit-repeated")  # a table, so that the join can split a hot text's rows
    rows = rows.join(groups, "digest", "left").withColumn("repeated", F.coalesce(F.col("doc_id") > F.col("smallest"), F.lit(False)))
    bits = [F.when(F.expr(f), 1 << i).otherwise(0) for i, f in enumerate((filters or FILTERS).values())]
    return rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("fails"))


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of rows (part, fails, good, toxic: long) for all orders of the letters."""
    if len(letters) > MAX_FILTERS:
        raise ValueError(f"more than {MAX_FILTERS} filters")
    orders = defaultdict(list)
    for order in permutations(letters):
        before = 0
        for letter in order:
            bit = 1 << letters.index(letter)
            orders[before, bit].append("".join(order))
            before |= bit
    cells = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    listed = [F.lit([k[0] for k in orders]).alias("before"), F.lit([k[1] for k in orders]).alias("bit"), F.lit([",".join(v) for v in orders.values()]).alias("orders")]
    each = cells.select("part", "cells", F.explode(F.arrays_zip(*listed)).alias("s")).select("part", "cells", "s.*")

    def of(which, what=lambda c: c["n"]):
        return F.aggregate(F.filter("cells", lambda c: which(c["fails"])), F.lit(0).cast("long"), lambda a, c: a + what(c))

    fails, before = (lambda m: m.bitwiseAND(F.col("bit")) > 0), (lambda m: m.bitwiseAND(F.col("before")) > 0)
    removed = lambda m: fails(m) & ~before(m)
    values = {
        "kept": of(lambda m: ~fails(m) & ~before(m)), "removed": of(removed), "redundant": of(lambda m: fails(m) & before(m)), "unique_fails": of(lambda m: m == F.col("bit")),
        "good_lost": of(removed, lambda c: c["good"]), "toxic_lost": of(removed, lambda c: c["toxic"]),
        # of k filters that a row fails each is the first in one k-th of all orders
        "shapley": of(fails, lambda c: c["n"] * (F.lit(math.factorial(len(letters))) / F.bit_count(c["fails"])).cast("long")),
    }
    out = each.select("part", "orders", (F.bit_count("before") + 1).cast("int").alias("step"), *[v.alias(k) for k, v in values.items()])
    return out.select("part", F.explode(F.split("orders", ",")).alias("filter_order"), "step", *values)


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = failures(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("part")))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = failed.join(labels, "doc_id", "left").select("part", "fails", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])
    return audit(rows, "".join(FILTERS))


OP12_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by t) as smallest from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        case when len(words) < 50 then 1 else 0 end
      + case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end
      + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end
      + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
      + case when w.doc_id > smallest then 16 else 0 end as fails
      from w left join l on w.doc_id = l.doc_id),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select a.letter || b.letter || x.letter || y.letter || z.letter as filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] as bits
      from letters a, letters b, letters x, letters y, letters z where (a.bit | b.bit | x.bit | y.bit | z.bit) = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (values (1), (2), (3), (4), (5)) v(step)),
g as (select part, filter_order, step, n, good, toxic, fails, bit, (fails & bit) > 0 as failing, (fails & before) > 0 as gone from c, s)
select part, filter_order, step::int as step,
  sum(case when not failing and not gone then n else 0 end)::bigint as kept,
  sum(case when failing and not gone then n else 0 end)::bigint as removed,
  sum(case when failing and gone then n else 0 end)::bigint as redundant,
  sum(case when fails = bit then n else 0 end)::bigint as unique_fails,
  sum(case when failing and not gone then good else 0 end)::bigint as good_lost,
  sum(case when failing and not gone then toxic else 0 end)::bigint as toxic_lost,
  sum(case when failing then n * 120 // bit_count(fails) else 0 end)::bigint as shapley
from g group by part, filter_order, step
"""
