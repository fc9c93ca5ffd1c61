"""Substring near-duplicates by compact windows.

A text's tokens are its shingles of five words (A-Z lower-cased). For a min-hash function, all passages with their least shingle at one place form a
compact window around it: from behind the next smaller shingle on the left to before the next smaller one on the right, which is that place's range in
the Cartesian tree of the hashes. Only places whose window holds a passage of MIN_WORDS words are kept, about two for each MIN_WORDS words of text.

Two min-hashes are joined over intersecting intervals: a key is a window's least shingle together with the least one, by a second function, of the NEAR
shingles to its right or to its left, as far as they lie in the window. Equal passages share such a key for each of FUNCTIONS pairs of functions. Each key's texts are linked to its least and to its greatest one (two stars, no pairs; of three texts all are
linked), and the windows are intersected at that alignment.

Such a key covers only a quarter of a passage, so its least and greatest text may share too little with two others that share all of it. Where a key has more than two
windows, their passages of exactly MIN_WORDS words around the least shingle are therefore keys too: all documents with the same one are linked to its
least, which has it as well, so each equal passage links each of its documents, whatever else has a part of it.

What is near but not equal can still be parted there, where the least and greatest text have a part only. So when the links are verified, the keys that have more than two windows and texts
of several classes are opened: similar passages have a run of RUN shingles in common (see RUN) and, if they are not equal, a break beside it: the texts go on differently, and within BRIDGE
shingles of the one and twice as many of the other a shingle is in both again, which is not one of the run's own where that has fewer than MOST different ones (too few for a break in them). All
texts of different classes that share a run with such a break in these windows are compared with each other. A line that many otherwise different texts have, and a word said again and again, have
no shared shingle behind their ends, so they make no pairs.

For each linked pair of documents the texts of the candidate stretch are compared: passages of MIN_WORDS words or more with a Jaccard similarity of their
shingles of at least 0.8 stay.

Equal texts are one text to all of this, the one of the smallest doc_id; each further copy of MIN_WORDS words or more has one passage, all of it, with that document.

Defined cases: null, empty and short texts have no windows; repeats inside one document are not reported; rows with the same doc_id and text are one
document; a null doc_id is reported as null; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import map_rows, stored, table
from entigraph.llm.components import components

SHINGLE, MIN_WORDS, SIMILAR = 5, 50, 0.8
WIDTH = MIN_WORDS - SHINGLE + 1
#: Shingles beside a window's least one among which the second function's least is taken: a quarter of a passage, so that one changed word in the middle of the
#: shortest passage leaves such a stretch on one side of each shingle.
NEAR = WIDTH // 4 + 1
#: Pairs of min-hash functions. An equal passage has a common key with each; of 55 words with the middle one changed (similarity 0.82) at least one in 97 of 100 cases.
FUNCTIONS = 2
#: Shingles in a row that two similar passages share at least: a break between shared runs costs them 9 different shingles or more, so there is one break in 46 to 89 shingles, with 41 shared ones on its
#: two sides; e > 1 breaks need 45 e shingles, of which 36 e lie in e + 1 runs.
RUN = 21
#: Shingles between shared ones that a passage may bridge: those that hold two changed words.
BRIDGE = 2 * SHINGLE
FAR = 2 * BRIDGE + 1
#: Different shingles that two similar passages share at least if one word is changed between them: a break costs 5 in one of them, SIMILAR of all are shared.
MOST = 20
#: Bytes of texts whose keys are found at once, as long as one text has not more.
PIECE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_MIX = np.random.default_rng(20240229).integers(1, 2**63, (FUNCTIONS + 1, 2), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray, f: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[f, 0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[f, 1]
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(x: int, n: int) -> np.ndarray:
    """x to the power of 0 to n - 1, from a table as long as the longest text so far."""
    if len(known := _POWERS.get(x, ())) < n:
        known = np.full(2 * n, x, np.uint64)
        known[0] = 1
        known = _POWERS[x] = np.multiply.accumulate(known)
    return known[:n]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit numbers of the texts' shingles: of the bytes of five words with single blanks between; how many each text has; and how many words."""
    split = [t.lower().split() for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    flat = b" ".join([b" ".join(w) for w in split if w])
    b = np.frombuffer(flat, np.uint8)
    blank = np.flatnonzero(b == 32)
    if len(blank) < SHINGLE - 1:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), size
    first = np.flatnonzero(np.arange(len(blank) + 1) + SHINGLE <= np.repeat(np.cumsum(size), size))  # words with as many as a shingle has in their text
    start = np.concatenate(([0], blank + 1))[first]
    end = np.concatenate((blank, [len(b)]))[first + SHINGLE - 1]
    # a polynomial of the bytes by differences of a running sum, moved to place 0 by the odd number's inverse modulo 2^64
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(b)))))
    return _mixed((run[end] - run[start]) * _powers(_INVERSE, len(b))[start], FUNCTIONS), np.maximum(size - SHINGLE + 1, 0), size


def shingles(text: bytes) -> np.ndarray:
    """Those of one text."""
    return shingles_of([text])[0]


def compact_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(place, first, last) of each compact window of at least `width` tokens: all passages within first..last over place have their least hash there (leftmost on ties)."""
    if len(h) < width:
        return []
    # a value is the least of some `width` in a row if it is the largest of the least ones of those around it
    ends = np.full(width - 1, 2**64 - 1, np.uint64)
    low = np.flatnonzero(~_least(np.concatenate((ends, ~_least(h, width), ends)), width) == h)
    # a window's neighbours that end it have wider windows themselves, so these places alone are enough for a stack
    value, place, n = h[low].tolist(), low.tolist(), len(h)
    first, last, stack = [0] * len(place), [n - 1] * len(place), []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            last[stack.pop()] = place[k] - 1
        first[k] = place[stack[-1]] + 1 if stack else 0
        stack.append(k)
    return [(c, a, z) for c, a, z in zip(place, first, last, strict=True) if z - a + 1 >= width]


def keys(texts: list[bytes], width: int = WIDTH) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Key, text, place, tokens of the window to the left, and to the right, of each window and side; and each text's number of words. A key of the first function is even, one of the others odd."""
    s, count, size = shingles_of(texts)
    near, out = min(NEAR, width), [(np.zeros(0, np.int64),) * 5]
    # the texts stand one behind another, each with a 0 behind it, which is less than all hashes and ends the windows around it
    of = np.repeat(np.arange(len(texts)), count + 1)
    base = np.cumsum(count + 1) - count - 1
    real = np.ones(len(of), bool)
    real[base + count] = False
    for f in range(FUNCTIONS if count.max(initial=0) >= width else 0):
        h, g = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
        h[real], g[real] = np.maximum(_mixed(s, f), np.uint64(1)), _mixed(s, (f + 1) % FUNCTIONS)
        least = _least(g, near)
        c, a, z = np.array(compact_windows(h, width), np.int64).reshape(-1, 3).T
        for side, at in ((0, c), (1, c - near + 1)):
            fits = np.flatnonzero((at >= a) & (at + near - 1 <= z) & real[c])
            x, at = c[fits], at[fits]
            number = _mixed(h[x] * np.uint64(_ODD) + least[at] + np.uint64(2 * f + side), FUNCTIONS)
            out.append((number.view(np.int64) & ~1 | (f > 0), of[x], x - base[of[x]], x - a[fits], z[fits] - x))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)), size


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of texts in a row that have PIECE bytes together, or of one that has more."""
    first = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > PIECE:
            yield first, k
            first, held = k, 0
        held += len(t)
    yield first, len(texts)


def passage_numbers(s: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit numbers of the passages of `width` of a text's shingles."""
    if len(s) < width:
        return np.zeros(0, np.uint64)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s * _powers(_ODD, len(s)))))
    return _mixed((run[width:] - run[:-width]) * _powers(_INVERSE, len(s))[: len(s) - width + 1], FUNCTIONS)


def windows(docs: DataFrame) -> DataFrame:
    """(key, rid, c, before, after) for docs (rid, text); a row without a key has in c the number of a text's words, where these are MIN_WORDS or more."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
            own, got, sizes = batch.column(0).to_numpy(), [], []
            for first, last in pieces(texts):
                (key, of, *places), words = keys(texts[first:last])
                got.append((key, own[first:last][of], *places))
                sizes.append(words)
            key, rid, *places = (np.concatenate(v) for v in zip(*got, strict=True))
            size = np.concatenate(sizes)
            long = size >= MIN_WORDS
            none = np.zeros(int(long.sum()), np.int64)
            columns = [np.concatenate(v).astype(np.int32) for v in zip(places, (size[long], none, none), strict=True)]
            no_key = np.arange(len(key) + len(none)) >= len(key)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((key, none)), mask=no_key), pa.array(np.concatenate((rid, own[long]))), *map(pa.array, columns)], ["key", "rid", "c", "before", "after"])

        return f

    return map_rows(docs, make, "key long, rid long, c int, before int, after int")


def numbered(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """The shingles of a and of b as numbers, equal where the shingles are."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    v = np.fromiter(map(ids.__getitem__, a + b), np.int64, len(a) + len(b))
    n = max(len(v) - SHINGLE + 1, 0)
    if len(ids) < 4096:  # five numbers of 12 bits
        s = sum(v[i : n + i] << 12 * i for i in range(SHINGLE))
    else:
        s = v[:n]
        for i in range(1, SHINGLE):
            s = np.unique(s * len(ids) + v[i : n + i], return_inverse=True)[1]
    s = s.tolist()
    return s[: max(len(a) - SHINGLE + 1, 0)], s[len(a) :]


def similar_stretches(a: list[str], b: list[str], least: int = MIN_WORDS, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start, end, similarity) in words of a and of b: passages of a that b has nearly alike.

    Each word of a that lies in a passage of `least` words that b has as well is in one of them. Runs of shared shingles are joined over gaps of at most BRIDGE; where the joined passage is not similar enough, its longest ranges of runs that are."""
    x, y = numbered(a, b)
    where: dict[int, list[int]] = {s: [] for s in set(x).intersection(y)}
    for j, s in enumerate(y):
        if s in where:
            where[s].append(j)
    runs: list[tuple[int, int, int]] = []  # first and last in x, first in y
    i = 0
    while i < len(x):
        if not (places := where.get(x[i])):
            i += 1
            continue
        goes_on = runs[-1][2] + runs[-1][1] - runs[-1][0] + 1 if runs else 0  # where y goes on after the last run
        k = bisect_left(places, goes_on)
        j, n = places[k] if k < len(places) else places[0], 0
        while len(u := x[i + n : i + n + 32]) == 32 and u == y[j + n : j + n + 32]:
            n += 32
        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
            n += 1
        runs.append((i, i + n - 1, j))
        i += n
    out = []

    def tell(group: list[tuple[int, int, int]]) -> bool:
        i0, i1 = group[0][0], group[-1][1]
        j0, j1 = min(r[2] for r in group), max(r[2] + r[1] - r[0] for r in group)
        if i1 - i0 + SHINGLE < least or j1 - j0 + SHINGLE < least:
            return False
        if len(group) == 1:  # the same shingles
            sim = 1.0
        else:
            p, q = set(x[i0 : i1 + 1]), set(y[j0 : j1 + 1])
            both = len(p & q)
            sim = both / (len(p) + len(q) - both)
        if sim >= similar:
            out.append((i0, i1 + SHINGLE, j0, j1 + SHINGLE, sim))
            return True
        return False

    k = 0
    while k < len(runs):
        m = k + 1
        while m < len(runs) and runs[m][0] - runs[m - 1][1] - 1 <= BRIDGE and 0 <= runs[m][2] - (runs[m - 1][2] + runs[m - 1][1] - runs[m - 1][0]) - 1 <= 2 * BRIDGE:
            m += 1
        if not tell(runs[k:m]):
            for u, v in _similar_ranges(x, y, runs[k:m], least - SHINGLE + 1, similar):
                tell(runs[k + u : k + v + 1])
        k = m
    # a run takes one place in y: equal passages at another place of it, or behind a run's start, are looked up as a whole
    told = bytearray(len(a))
    for i, m, *_ in out:
        told[i:m] = b"\1" * (m - i)
    # they lie where shingles that b has follow each other, run by run
    stretches: list[list[int]] = []
    for i, m, _ in runs:
        if stretches and stretches[-1][1] == i + SHINGLE - 1:
            stretches[-1][1] = m + SHINGLE
        else:
            stretches.append([i, m + SHINGLE])
    if not any(m - i >= least and 0 in told[i:m] for i, m in stretches):
        return out
    first: dict[tuple, int] = {}
    for j in range(len(b) - least + 1):
        first.setdefault(tuple(b[j : j + least]), j)
    i = 0
    while i + least <= len(a):
        if (j := first.get(tuple(a[i : i + least]))) is None:
            i += 1
            continue
        n = least
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if 0 in told[i : i + n]:
            out.append((i, i + n, j, j + n, 1.0))
            told[i : i + n] = b"\1" * n
        i += n - least + 1
    return sorted(out)


def _before(s: list) -> np.ndarray:
    """For each place, where its shingle stood last before it, or -1."""
    seen: dict = {}
    out = np.empty(len(s), np.int64)
    for i, t in enumerate(s):
        out[i] = seen.get(t, -1)
        seen[t] = i
    return out


def _similar_ranges(x: list, y: list, group: list[tuple[int, int, int]], width: int, similar: float) -> list[tuple[int, int]]:
    """First and last run of each range of the group's runs, of `width` shingles or more, that is similar enough and lies in no other such range.

    Shingles of x between runs are not in y, so those of a range that both have are the distinct ones of its runs in x."""
    i0, j0 = group[0][0], group[0][2]
    i = np.array([r[0] for r in group]) - i0
    ends = np.array([r[1] for r in group]) - i0
    j = np.array([r[2] for r in group]) - j0
    jends = j + ends - i
    if len(group) == 1 or ends[-1] + 1 < width or jends[-1] + 1 < width:
        return []
    px, py = _before(x[i0 : i0 + int(ends[-1]) + 1]), _before(y[j0 : j0 + int(jends[-1]) + 1])
    shared = np.zeros(len(px), bool)
    for p, q in zip(i.tolist(), ends.tolist(), strict=True):
        shared[p : q + 1] = True
    out, last = [], -1
    for u in range(len(group)):
        new = px[i[u] :] < i[u]
        mine = np.cumsum(new)[ends[u:] - i[u]]
        both = np.cumsum(new & shared[i[u] :])[ends[u:] - i[u]]
        theirs = np.cumsum(py[j[u] :] < j[u])[jends[u:] - j[u]]
        fits = np.flatnonzero((ends[u:] - i[u] + 1 >= width) & (jends[u:] - j[u] + 1 >= width) & (both / (mine + theirs - both) >= similar))
        if len(fits) and u + int(fits[-1]) > last:
            last = u + int(fits[-1])
            out.append((u, last))
    return out


def equal_passages(docs: DataFrame) -> DataFrame:
    """(passage, rid, at): of docs (rid, text, around) each passage of WIDTH shingles within one of `around`, array<struct<c, before, after>>, that holds its c."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            numbers, rid, at = [], [], []
            for r, t, around in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                n = passage_numbers(shingles((t.as_py() or "").encode("utf-8", "replace")))
                wanted = np.zeros(len(n), bool)
                for w in around:
                    wanted[max(w["c"] - min(w["before"], WIDTH - 1), 0) : w["c"] + min(w["after"], WIDTH - 1) - WIDTH + 2] = True
                places = np.flatnonzero(wanted)
                numbers.append(n[places].view(np.int64))
                rid.append(np.full(len(places), r, np.int64))
                at.append(places.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (numbers, rid, at)], ["passage", "rid", "at"])

        return f

    return map_rows(docs.select("rid", "text", "around"), make, "passage long, rid long, at int")


def beside_again(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, where its shingle stands last before it, or -1, and first after it, or the number of shingles."""
    order = np.argsort(s, kind="stable")
    same = np.flatnonzero(s[order[1:]] == s[order[:-1]])
    earlier, later = np.full(len(s), -1), np.full(len(s), len(s))
    earlier[order[same + 1]] = order[same]
    later[order[same]] = order[same + 1]
    return earlier, later


def shared_runs(docs: DataFrame) -> DataFrame:
    """(run, rid, at, lo, hi, again, before, after, all): of docs (rid, text, around) each run of RUN shingles within one of `around`, array<struct<c, before, after>>, the first and last shingle of those it
    lies in and numbers of the shingles before and after the run, null where no shingle within reach there can tell of a break, or the same run
    comes again within reach, which tells it; whether the text has the run again; and a row without a run for each text, with numbers of all its
    shingles in `all`."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, ends, every, repeated = [], [], [], []
            for r, t, around in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = shingles((t.as_py() or "").encode("utf-8", "replace"))
                n = passage_numbers(s, RUN)
                lo, hi = np.full(len(n), len(n) + RUN, np.int32), np.full(len(n), -1, np.int32)
                for w in around:
                    a, z = w["c"] - w["before"], w["c"] + w["after"]
                    lo[a : z - RUN + 2] = np.minimum(lo[a : z - RUN + 2], a)
                    hi[a : z - RUN + 2] = np.maximum(hi[a : z - RUN + 2], z)
                at = np.flatnonzero(hi >= 0)
                out.append((n[at].view(np.int64), np.full(len(at), r, np.int64), at.astype(np.int32), lo[at], hi[at]))
                short = (s >> np.uint64(32)).astype(np.uint32).view(np.int32)
                every.append(short)
                earlier, later = beside_again(n)
                repeated.append((earlier[at] >= 0) | (later[at] < len(n)))
                first, last = (earlier[at] < 0) | (at - earlier[at] > FAR), (later[at] == len(n)) | (later[at] - at > FAR)
                earlier, later = beside_again(s)
                many = (earlier[at[:, None] + np.arange(RUN)] < at[:, None]).sum(1) >= MOST
                reach = np.arange(FAR)
                left, right = at[:, None] - 1 - reach, at[:, None] + RUN + reach
                told_left = (at > 0) & first & (many | ((left >= 0) & (later[np.maximum(left, 0)] >= at[:, None] + RUN)).any(1))
                told_right = (at + RUN < len(s)) & last & (many | ((right < len(s)) & (earlier[np.minimum(right, len(s) - 1)] < at[:, None])).any(1))
                ends.append((short[at - 1], ~told_left, short[np.minimum(at + RUN, len(s) - 1)], ~told_right) if len(at) else (np.zeros(0, np.int32), np.zeros(0, bool)) * 2)
            run, rid, *places = (np.concatenate(a) for a in zip(*out, strict=True))
            before, no_before, after, no_after = (np.concatenate(a) for a in zip(*ends, strict=True))
            none = len(every)
            again = pa.array(np.concatenate((*repeated, np.zeros(none, bool))))
            first = [pa.array(np.concatenate((run, np.zeros(none, np.int64))), mask=np.arange(len(run) + none) >= len(run)), pa.concat_arrays([pa.array(rid), batch.column(0)])]
            beside = [pa.concat_arrays([pa.array(v, mask=m), pa.nulls(none, pa.int32())]) for v, m in ((before, no_before), (after, no_after))]
            full = pa.concat_arrays([pa.nulls(len(run), pa.list_(pa.int32())), pa.array(every, pa.list_(pa.int32()))])
            return pa.RecordBatch.from_arrays([*first, *[pa.array(np.concatenate((p, np.zeros(none, np.int32)))) for p in places], again, *beside, full], ["run", "rid", "at", "lo", "hi", "again", "before", "after", "all"])

        return f

    return map_rows(docs.select("rid", "text", "around"), make, "run long, rid long, at int, lo int, hi int, again boolean, before int, after int, all array<int>")


def _cut(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, other, lo, words): of docs (rid, doc_id, text, other, lo, hi) the words of shingles lo..hi, A-Z lower-cased."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, lo, hi = batch.column(2), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            got = [b" ".join(t.as_py().encode("utf-8", "replace").lower().split()[a : b + SHINGLE]) for t, a, b in zip(text, lo, hi, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array([g.decode() for g in got], pa.string())], ["rid", "doc_id", "other", "lo", "words"])

        return f

    return map_rows(docs.select("rid", "doc_id", "text", "other", "lo", "hi"), make, "rid long, doc_id long, other long, lo int, words string")


def _with_text(docs: DataFrame, need: DataFrame) -> DataFrame:
    """need (rid, doc_id, ...) with the text of that document."""
    return docs.join(need.withColumnRenamed("doc_id", "first"), "rid").where(F.col("doc_id").eqNullSafe(F.col("first"))).drop("first")


def shared_windows(w: DataFrame) -> DataFrame:
    """The windows of keys that several texts have, with the key's least and greatest text (rep, most) and its number of windows (n)."""
    shared = w.groupBy("key").agg(F.min("rid").alias("rep"), F.max("rid").alias("most"), F.count("*").alias("n")).where("rep <> most")
    # stored, a row a key: read from there, the joins can split a key that many windows have
    return stored(w.join(stored(shared, "passage-shared"), "key"), "passage-shared-windows")


def candidates(docs: DataFrame, firsts: DataFrame, w: DataFrame) -> DataFrame:
    """(rid, other, a0, a1, b0, b1): texts linked to another one, and in either the stretch of shingles that the common windows cover. docs: (rid, doc_id, text), rid the text's; firsts (rid,
    doc_id): the document that stands for a text; w: the shared windows of docs."""
    at = F.struct("c", "before", "after")
    stars = w.where("rid = rep or rid = most").groupBy("key").agg(F.min(F.when(F.expr("rid = rep"), at)).alias("first"), F.min(F.when(F.expr("rid = most"), at)).alias("last"))
    # a window that ends where the least text's ends, on both sides, has the same text: what is like the one is like the other, and the greatest need not be asked
    ask = F.expr("array_compact(array(if(rid <> rep, struct(rep as other, first as at), null), if(rid <> rep and rid <> most and not (before = first.before and after = first.after), struct(most as other, last as at), null)))")
    linked = w.join(stored(stars, "passage-stars"), "key").select("rid", "c", "before", "after", F.explode(ask).alias("s")).select(
        "rid", "s.other", "c", F.col("s.at.c").alias("rc"), F.least("before", "s.at.before").alias("before"), F.least("after", "s.at.after").alias("after"),
    ).where(f"before + after + 1 >= {WIDTH}").selectExpr("rid", "other", "c - before as a0", "c + after as a1", "rc - before as b0", "rc + after as b1")
    # equal passages have a key of the first function in common; two windows alone have been compared with each other
    around = w.where("n > 2 and key % 2 = 0").groupBy("rid").agg(F.collect_set(F.struct("c", "before", "after")).alias("around"))
    exact = stored(equal_passages(_with_text(docs, around.join(firsts, "rid"))), "passage-equal")
    heads = exact.groupBy("passage").agg(F.min(F.struct("rid", "at")).alias("rep"), F.max("rid").alias("most")).where("rep.rid <> most").drop("most")
    heads = stored(heads, "passage-firsts")
    last = WIDTH - 1
    alike = exact.join(heads, "passage").where("rid <> rep.rid").selectExpr("rid", "rep.rid as other", "at as a0", f"at + {last} as a1", "rep.at as b0", f"rep.at + {last} as b1")
    return linked.unionByName(alike).groupBy("rid", "other").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))


def parted(docs: DataFrame, firsts: DataFrame, w: DataFrame, found: DataFrame) -> DataFrame:
    """As candidates(), of the texts that found (rid, other) has in different classes: all that share a run with a break beside it in windows of keys that have several classes."""
    some = w.where("n > 2").select("key", "rid", "c", "before", "after").distinct()
    of = components(found.select(F.col("rid").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "rid")
    some = stored(some.join(of, "rid", "left").withColumn("root", F.coalesce("root", "rid")), "passage-classes")
    several = some.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    around = some.join(several, "key", "left_semi").groupBy("rid").agg(F.collect_set(F.struct("c", "before", "after")).alias("around"), F.first("root").alias("root"))
    around = stored(around.join(firsts, "rid"), "passage-open")
    runs = stored(shared_runs(_with_text(docs, around.drop("root"))).join(around.select("rid", "root"), "rid"), "passage-runs")
    shingle = runs.where("run is null").select("rid", "all")
    # a run has a break beside it where texts go on differently, or some have it again and again
    side = lambda c: f"{c} is not null and (more or low_{c} <> high_{c})"
    between = runs.where("run is not null").groupBy("run").agg(*[f(c).alias(f"{n}_{c}") for c in ("root", "before", "after") for n, f in (("low", F.min), ("high", F.max))], F.max("again").alias("more"))
    between = between.where("low_root <> high_root and (more or low_before <> high_before or low_after <> high_after)")
    sides = F.expr(f"array_compact(array(if({side('before')}, struct(true as left, before as beside), null), if({side('after')}, struct(false as left, after as beside), null)))")
    ends = stored(runs.where("before is not null or after is not null").join(between, "run").select("run", "rid", "root", "at", "lo", "hi", "again", F.explode(sides).alias("s")).select("run", "rid", "root", "at", "lo", "hi", "again", "s.*"), "passage-ends")
    # what is beside the end of a run, from there outwards
    beyond = F.expr(f"if(left, reverse(slice(all, greatest(at - {FAR}, 0) + 1, least(at, {FAR}))), slice(all, at + {RUN + 1}, {FAR}))")
    own = F.expr(f"slice(all, at + 1, {RUN})")
    near = ends.join(shingle, "rid").select("run", "rid", "root", "at", "lo", "hi", "again", "left", "beside", own.alias("own"), (F.size(F.array_distinct(own)) >= MOST).alias("many"), F.posexplode(beyond).alias("d", "near"))
    # a run that a text repeats has no alignment: all of its windows is compared
    near = near.where("many or not array_contains(own, near)").groupBy("run", "left", "near", "rid", "beside", "d").agg(
        F.first("root").alias("root"), F.min("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("again").alias("again"),
    )
    near, by = stored(near, "passage-near"), ["run", "left", "near"]
    several = near.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("root", "beside", "d") for n, f in (("low", F.min), ("high", F.max))], F.max("again").alias("more"))
    several = several.where("low_root <> high_root and (more or low_beside <> high_beside or low_d <> high_d)")
    near = stored(near.join(several.select(*by), by, "left_semi"), "passage-breaks")
    other = near.select(*by, *[F.col(c).alias(f"o_{c}") for c in ("rid", "root", "at", "lo", "hi", "again", "beside", "d")])
    both = near.join(other, by).where(f"rid > o_rid and root <> o_root and d <= {BRIDGE} and (beside <> o_beside or d <> o_d or again or o_again)")
    left, right = f"least(at - lo, o_at - o_lo) + {BRIDGE}", f"least(hi - at, o_hi - o_at) + {BRIDGE}"
    whole = "again or o_again"
    return both.groupBy("rid", F.col("o_rid").alias("other")).agg(
        F.min(F.expr(f"if({whole}, lo, greatest(at - ({left}), lo))")).alias("a0"), F.max(F.expr(f"if({whole}, hi, least(at + {right}, hi))")).alias("a1"),
        F.min(F.expr(f"if({whole}, o_lo, greatest(o_at - ({left}), o_lo))")).alias("b0"), F.max(F.expr(f"if({whole}, o_hi, least(o_at + {right}, o_hi))")).alias("b1"),
    )


def verified(rows: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rid, other, doc_id, start, end, rep_doc_id, rep_start, rep_end, similarity) of the pairs that candidates() gives."""
    reps = pairs.groupBy(F.col("other").alias("rid")).agg(F.min("b0").alias("lo"), F.max("b1").alias("hi"))
    need = pairs.select("rid", "other", F.col("a0").alias("lo"), F.col("a1").alias("hi")).unionByName(reps.withColumn("other", F.lit(None).cast("long")))
    cut = stored(_cut(_with_text(rows, need.join(firsts, "rid"))), "passage-texts").dropDuplicates(["rid", "other"])
    mine = cut.where("other is not null")
    theirs = cut.where("other is null").select(F.col("rid").alias("other"), F.col("doc_id").alias("rep_doc_id"), F.col("lo").alias("rep_lo"), F.col("words").alias("rep_words"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, other, d, lo, words, rd, rlo, rwords in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words == rwords:  # a copy: one stretch, all of it
                    n = words.count(" ") + 1
                    out += [(rid, other, d, lo, lo + n, rd, rlo, rlo + n, 1.0)] if n >= MIN_WORDS else []
                    continue
                out += [(rid, other, d, lo + i, lo + j, rd, rlo + p, rlo + q, s) for i, j, p, q, s in similar_stretches(words.split(" "), rwords.split(" "))]
            cols = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 8 else pa.int64()) for k, c in enumerate(cols)], ["rid", "other", "doc_id", "start", "end", "rep_doc_id", "rep_start", "rep_end", "similarity"])

    both = mine.join(theirs, "other").select("rid", "other", "doc_id", "lo", "words", "rep_doc_id", "rep_lo", "rep_words")
    return both.mapInArrow(verify, "rid long, other long, doc_id long, start long, end long, rep_doc_id long, rep_start long, rep_end long, similarity double")


def near_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, rep_doc_id, rep_start, rep_end, similarity): passages in words, end exclusive, that a class's representative has nearly alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("text"))
    w = stored(windows(rows.select("rid", "text")), "passage-windows")
    ids = stored(rows.select("rid", "doc_id"), "passage-ids")
    firsts = stored(ids.groupBy("rid").agg(F.min("doc_id").alias("doc_id")), "passage-texts-of")
    shared = shared_windows(w.where("key is not null"))
    found = stored(verified(rows, firsts, stored(candidates(rows, firsts, shared), "passage-pairs")), "passage-links")
    found = found.unionByName(verified(rows, firsts, stored(parted(rows, firsts, shared, found), "passage-parted"))).drop("rid", "other")
    zero = F.lit(0).cast("long")
    copies = ids.join(firsts.withColumnRenamed("doc_id", "first"), "rid").where("doc_id <> first or doc_id is null and first is not null").distinct()
    copies = copies.join(w.where("key is null").select("rid", F.col("c").cast("long").alias("n_words")).distinct(), "rid")
    return found.unionByName(copies.select("doc_id", zero.alias("start"), F.col("n_words").alias("end"), F.col("first").alias("rep_doc_id"), zero.alias("rep_start"), F.col("n_words").alias("rep_end"), F.lit(1.0).alias("similarity")))


def classes(found: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of documents in found (doc_id, rep_doc_id): class_id is the smallest doc_id that links lead to, n_links the number of other
    documents that a document is linked to itself. Null ids have no class."""
    pairs = found.select("doc_id", "rep_doc_id").where("doc_id is not null and rep_doc_id is not null and doc_id <> rep_doc_id").distinct()
    links = pairs.union(pairs.select("rep_doc_id", "doc_id")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_links"))
    of = components(pairs.select(F.col("doc_id").alias("u"), F.col("rep_doc_id").alias("v")))
    return of.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id")).join(links, "doc_id")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages, each with the class of its documents and the links of the first."""
    found = stored(near_passages(table(spark, sf_dir, "documents")), "passage-found")
    return found.join(classes(found), "doc_id", "left")
