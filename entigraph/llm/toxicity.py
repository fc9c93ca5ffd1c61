"""Toxicity: a learned lexicon, its misspellings by Levenshtein automata, and scores of the words around a match.

The lexicon are words that far more toxic rows have than others do (by the likelihood ratio of their counts in all labelled rows; a word counts once for each pair of words
that it stands between there, so the words of one text with many copies don't count as terms do). Its terms are a trie; the words of a text run through the automaton of all strings within a term's edit distance, which is the Levenshtein automaton intersected with the trie: a state is a set of (node, errors), made when a word first
comes to it, and the distinct words of a batch run abreast. A match weighs as its term at its distance does (log-odds in the labelled rows, shrunk towards a part of the term's own).
A term is given only as many edits as tell something: where words near it are common in other rows they are no misspellings. A match is scored by its window: whether it is quoted, and the words within WINDOW words and REACH characters of it, each by its log-odds in windows of toxic and of other rows. So the same word
counts for little where it is reported and for much where it is thrown at someone. A text's distinct (term, distance), each at its worst place, are summed; a logistic curve over this sum,
the worst one, and the text's length makes the score.

Counts are taken over all labelled rows. In fitting the curve each row's own counts are left out of its weights. The curve is fitted to at most FIT_ROWS rows that have matches, those of
the least hashes, and to the number of those that have none. MAX_TERMS and MAX_CONTEXT bound the model, which goes to every task; the strongest are kept.

Defined cases: a null text counts as empty, and texts without a match have the curve's value for none; null labels and labels other than 0 and 1 are not learned from; several labels of
one doc_id count as several rows; with one class to learn from the score is that class, 0.5 for none; ties are broken by the term; long texts are read in pieces cut at blanks (windows are
of the whole text); a null doc_id is not held out; extra columns are kept by `find` and `score`, text is not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import map_rows, stored, table

#: Runs of letters and digits, joined by signs that stand for letters.
TOKEN = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+)*")
OPENING, CLOSING = "«„“‘‹", "»“”’›"
WINDOW, REACH = 4, 200
LONGEST = 40
MAX_TERMS, MAX_CONTEXT, FIT_ROWS = 5_000, 5_000, 50_000
#: A term's likelihood ratio is above 2 ln(labelled rows) + MARGIN, and its toxic share this many times the share in all rows.
MARGIN, TIMES = 8.0, 3.0
#: Rows' worth of a prior share; what part of a term's log-odds an edit leaves, before it is seen; the log-odds that a distance must have.
PRIOR, LEFT, LEAST = 2.0, 0.6, 1.0
THRESHOLD = 0.7
#: Characters of a piece; words kept as known; states of the automaton between two of its runs.
PIECE, MAX_KNOWN, MAX_STATES = 1_000_000, 300_000, 200_000
MATCH = "struct<start:int,end:int,term:string,distance:int,quoted:boolean,context:array<string>>"


def allowed(term: str) -> int:
    """Edits that a term's misspelling may have."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """All words within their allowed distance of a term: states are made as words come to them."""

    def __init__(self, terms: tuple[str, ...], limits: tuple[int, ...] | None = None) -> None:
        self.terms, self.limits = terms, tuple(map(allowed, terms)) if limits is None else limits
        letters = sorted({c for t in terms for c in t})
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no term
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.next_node: list[dict[int, int]] = [{}]
        self.term, self.reach = [-1], [0]
        for i, (t, most) in enumerate(zip(terms, self.limits, strict=True)):
            at = 0
            self.reach[0] = max(self.reach[0], most)
            for c in self.kind[[ord(c) for c in t]].tolist():
                if c not in self.next_node[at]:
                    self.next_node[at][c] = len(self.term)
                    self.next_node.append({})
                    self.term.append(-1)
                    self.reach.append(0)
                at = self.next_node[at][c]
                self.reach[at] = max(self.reach[at], most)
            self.term[at] = i
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.table = np.full((64, self.width), -1, np.int32)
        self.state({})  # the dead one, 0
        self.state({0: 0})

    def state(self, found: dict[int, int]) -> int:
        """The number of a set {node: errors}, with all nodes that left-out letters lead to."""
        todo = list(found)
        while todo:
            n = todo.pop()
            e = found[n] + 1
            for m in self.next_node[n].values():
                if e <= self.reach[m] and e < found.get(m, 99):
                    found[m] = e
                    todo.append(m)
        key = tuple(sorted(found.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.accepts.append(min(((e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= self.limits[self.term[n]]), default=None))
            if len(self.sets) > len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        return self.ids[key]

    def step(self, state: int, letter: int) -> int:
        found: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.reach[n] and e < found.get(n, 99):
                found[n] = e

        for n, e in self.sets[state]:
            put(n, e + 1)
            for c, m in self.next_node[n].items():
                put(m, e + (c != letter))
        return self.state(found)

    def run(self, words: list[str]) -> list[tuple[int, int] | None]:
        """(distance, term's number) of the nearest term of each word, None if none is near enough."""
        if len(self.sets) > MAX_STATES:
            self.clear()
        size = np.array([len(w) for w in words], np.int64)
        data = self.kind[np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)]
        first, state = np.cumsum(size) - size, np.ones(len(words), np.int32)
        live, t = np.flatnonzero(size > 0), 0
        while len(live):
            letter = data[first[live] + t]
            got = self.table[state[live], letter]
            if (lost := got < 0).any():
                for x in np.unique(state[live[lost]].astype(np.int64) * self.width + letter[lost]).tolist():
                    s, c = divmod(x, self.width)
                    to = self.step(s, c)
                    self.table[s, c] = to
                got = self.table[state[live], letter]
            state[live] = got
            t += 1
            live = live[(got > 0) & (size[live] > t)]
        return [self.accepts[s] for s in state.tolist()]


@lru_cache(maxsize=1)
def automaton(terms: tuple[str, ...], limits: tuple[int, ...] | None = None) -> Automaton:
    """Kept by a worker from one task to the next."""
    return Automaton(terms, limits)


def pieces(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Cut at blanks, so that no token is in two; a piece without one is longer."""
    a = 0
    while a < len(text):
        b = a + size
        while b < len(text) and not text[b].isspace():
            b += 1
        yield a, min(b, len(text))
        a = b


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens before a span and closes after it, within REACH characters."""
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    if before.count('"') % 2 == 1 and '"' in after:
        return True
    opens, closes = max(map(before.rfind, OPENING)), max(before.rfind(c) for c in CLOSING if c not in OPENING)
    return opens > closes and any(c in after for c in CLOSING)


class Finder:
    """The matches of a lexicon in texts, with what is around them."""

    def __init__(self, terms: tuple[str, ...], limits: tuple[int, ...] | None = None, piece: int = PIECE) -> None:
        self.auto, self.piece = automaton(terms, limits), piece
        self.known: set[str] = set()
        self.near: dict[str, tuple[int, int]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > MAX_KNOWN:
            self.known, self.near = set(), {}
            new = list(words)
        else:
            new = list(words - self.known)
        self.known.update(new)
        for w, hit in zip(new, self.auto.run([w.lower() for w in new]), strict=True):
            if hit:
                self.near[w] = hit

    def find(self, texts: list[str]) -> list[tuple[int, list[tuple]]]:
        """(number of words, matches) of each text; short ones are looked at together."""
        out: list[tuple[int, list[tuple]]] = [(0, [])] * len(texts)
        held: list[tuple[int, int, int, set[str], int]] = []
        chars = 0

        def close() -> None:
            nonlocal chars
            self.learn(set().union(*(h[3] for h in held)) if held else set())
            for i, a, b, words, n in held:
                matches = self.matches(texts[i], a, b) if not words.isdisjoint(self.near) else []
                out[i] = (out[i][0] + n, out[i][1] + matches)
            held.clear()
            chars = 0

        for i, text in enumerate(texts):
            for a, b in pieces(text, self.piece):
                words = TOKEN.findall(text, a, b)
                held.append((i, a, b, set(words), len(words)))
                chars += b - a
                if chars >= self.piece:
                    close()
        close()
        return out

    def matches(self, text: str, a: int, b: int) -> list[tuple]:
        out = []
        for m in TOKEN.finditer(text, a, b):
            if hit := self.near.get(m[0]):
                s, e = m.span()
                before, after = TOKEN.findall(text, max(0, s - REACH), s)[-WINDOW:], TOKEN.findall(text, e, e + REACH)[:WINDOW]
                out.append((s, e, self.auto.terms[hit[1]], hit[0], quoted(text, s, e), [w.lower() for w in (*before, *after)]))
        return out


def _columns(docs: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")


def find(docs: DataFrame, terms: tuple[str, ...], limits: tuple[int, ...] | None = None, piece: int = PIECE) -> DataFrame:
    """All columns of docs but text, with the number of its words and its matches in order. limits: the edits that each term's misspellings may have."""
    docs = docs.drop("words", "matches").withColumn("text", F.col("text").cast("string"))
    keep = [c for c in docs.columns if c != "text"]

    def make():
        finder = Finder(terms, limits, piece)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            col = batch.schema.names.index
            got = finder.find([t.as_py() or "" for t in batch.column(col("text"))])
            names = ("start", "end", "term", "distance", "quoted", "context")
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("distance", pa.int32()), ("quoted", pa.bool_()), ("context", pa.list_(pa.string()))]))
            found = pa.array([[dict(zip(names, m, strict=True)) for m in ms] for _, ms in got], kind)
            return pa.RecordBatch.from_arrays([*(batch.column(col(c)) for c in keep), pa.array([n for n, _ in got], pa.int64()), found], [*keep, "words", "matches"])

        return f

    return map_rows(docs, make, f"{_columns(docs)}words long, matches array<{MATCH}>")


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


class Model:
    """Counts of rows, (other, toxic), by term and distance, by quotation and by word of a window; and the curve's coefficients. constant: the score of all texts, if there is nothing to tell."""

    def __init__(self, rows: tuple[int, int], terms: dict[str, tuple[int, int]], constant: float | None = None) -> None:
        self.rows, self.terms, self.constant = rows, tuple(sorted(terms)), constant
        self.counts: dict[tuple[str, int], tuple[int, int]] = {(t, 0): n for t, n in terms.items()}
        self.hits = (0, 0)
        self.quoted: dict[bool, tuple[int, int]] = {}
        self.context: dict[str, tuple[int, int]] = {}
        self.curve = np.zeros(5)

    def _odds(self, n: tuple[int, int], prior: float, base: float) -> float:
        """The log-odds of a share that is shrunk towards prior, over base."""
        return _logit((n[1] + PRIOR * prior) / (n[0] + n[1] + PRIOR)) - _logit(base)

    def weight(self, term: str, distance: int, own: int | None = None) -> float:
        """own: the label of a row whose counts are left out."""
        base = (self.rows[1] + 1) / (sum(self.rows) + 2)
        n = self.counts.get((term, distance), (0, 0))
        if own is not None:
            n = (max(0, n[0] - (own == 0)), max(0, n[1] - (own == 1)))
        prior = base
        if distance:
            prior = 1 / (1 + math.exp(-_logit(base) - LEFT**distance * self.weight(term, 0)))
        return self._odds(n, prior, base)

    def limits(self) -> tuple[int, ...]:
        """The edits that tell something, of each term."""
        out = []
        for t in self.terms:
            d = 0
            while d < allowed(t) and self.weight(t, d + 1) > LEAST:
                d += 1
            out.append(d)
        return tuple(out)

    def around(self, is_quoted: bool, context: list[str]) -> float:
        base = (self.hits[1] + 1) / (sum(self.hits) + 2)
        return self._odds(self.quoted.get(is_quoted, (0, 0)), base, base) + sum(self._odds(self.context[w], base, base) for w in set(context) if w in self.context)

    def features(self, words: int, matches: list[tuple], own: int | None = None) -> list[float]:
        worst: dict[tuple[str, int], float] = {}
        for _, _, term, distance, is_quoted, context in matches:
            s = self.weight(term, distance, own) + self.around(is_quoted, context)
            worst[term, distance] = max(s, worst.get((term, distance), -99.0))
        if not worst:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        return [1.0, 1.0, sum(worst.values()) / 4, max(worst.values()) / 4, math.log(1 + words) / 4]

    def score(self, words: int, matches: list[tuple]) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.curve @ self.features(words, matches))))))


def _ratio(n1: Column, n0: Column, of1: Column | float, of0: Column | float) -> Column:
    """The likelihood ratio of two counts against one rate for both."""
    p = (n1 + n0) / (of1 + of0)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (of * p))).otherwise(0.0)
    return 2 * (part(n1, of1) + part(n0, of0))


def _counted(rows: DataFrame, each: Callable[[str, list[str]], set[str]]) -> DataFrame:
    """(key, n): rows (text) that have a key, among those that each() makes of a text's words; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["key", "n"])

        for batch in batches:
            for t in batch.column(0):
                text, keys = t.as_py() or "", set()
                for a, b in pieces(text, PIECE):
                    keys |= each(TOKEN.findall(text, a, b))
                n.update(keys)
                if len(n) > MAX_KNOWN:
                    yield out()
                    n.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "key string, n long")


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word, n): rows (text) that have a word, lower-cased, of up to LONGEST characters."""
    return _counted(rows, lambda words: {w.lower() for w in set(words) if len(w) <= LONGEST}).withColumnRenamed("key", "word")


def places(rows: DataFrame) -> DataFrame:
    """(word, n): distinct pairs of words that a word stands between in rows (text)."""

    def each(words: list[str]) -> set[str]:
        return {f"{w} {u[:LONGEST]} {v[:LONGEST]}".lower() for u, w, v in {*zip(["", *words], words, [*words[1:], ""], strict=False)} if len(w) <= LONGEST}

    return _counted(rows, each).select("key").distinct().groupBy(F.substring_index("key", " ", 1).alias("word")).agg(F.count("*").alias("n"))


def lexicon(rows: DataFrame, n0: int, n1: int) -> dict[str, tuple[int, int]]:
    """{term: (other rows, toxic rows)} from rows (text, y)."""
    need = 2 * math.log(n0 + n1) + MARGIN
    least = max(2, math.ceil(need / (2 * math.log((n0 + n1) / n1))))  # with fewer no word comes so far
    some = stored(places(rows.where("y = 1")).where(F.col("n") >= least), "toxic-words")

    def rows_with(y: int, name: str) -> DataFrame:
        # words meet the candidates before they are shuffled, where Spark finds these small enough to send
        return vocabulary(rows.where(F.col("y") == y)).join(some.select("word"), "word", "left_semi").groupBy("word").agg(F.sum("n").alias(name))

    both = some.join(rows_with(1, "n1"), "word").join(rows_with(0, "n0"), "word", "left").withColumn("n0", F.coalesce("n0", F.lit(0)))
    share = F.col("n1") / (F.col("n0") + F.col("n1"))
    both = both.withColumn("ratio", _ratio(F.least("n", "n1"), F.col("n0"), float(n1), float(n0))).where((F.col("ratio") > need) & (share > min(0.5, TIMES * n1 / (n0 + n1))))
    return {r.word: (int(r.n0), int(r.n1)) for r in both.orderBy(F.desc("ratio"), "word").limit(MAX_TERMS).collect()}


def _by_label(df: DataFrame, *keys: str) -> dict:
    rows = df.groupBy(*keys).agg(F.sum(F.lit(1) - F.col("y")).alias("n0"), F.sum("y").alias("n1")).collect()
    return {(tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]): (int(r.n0), int(r.n1)) for r in rows}


def train(rows: DataFrame) -> Model:
    """rows: doc_id, text, y; each with y of 0 or 1 is learned from."""
    rows = stored(rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("y").cast("int").alias("y")).where("y in (0, 1)"), "toxicity-rows")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model((n0, n1), {}, 0.5 if not n else float(n1 > 0))
    model = Model((n0, n1), lexicon(rows, n0, n1))
    if not model.terms:
        model.constant = n1 / (n0 + n1)
        return model
    found = stored(find(rows, model.terms).where(F.size("matches") > 0), "toxicity-matches")
    # what a row has several times counts once
    near = found.select("y", F.explode(F.array_distinct(F.transform("matches", lambda m: F.struct(m["term"].alias("term"), m["distance"].alias("distance"))))).alias("m")).select("y", "m.*").where("distance > 0")
    model.counts |= _by_label(near, "term", "distance")
    found = stored(within(found, model), "toxicity-matches")
    model.hits = tuple(sum(v[i] for v in _by_label(found.withColumn("k", F.lit(0)), "k").values()) for i in (0, 1))
    model.quoted = _by_label(found.select("y", F.explode(F.array_distinct("matches.quoted")).alias("quoted")), "quoted")
    words = found.select("y", F.explode(F.array_distinct(F.flatten("matches.context"))).alias("word")).groupBy("word").agg(F.sum(F.lit(1) - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    ratio = _ratio(F.col("n1"), F.col("n0"), max(1.0, float(model.hits[1])), max(1.0, float(model.hits[0])))
    words = words.withColumn("ratio", ratio).where(F.col("ratio") > 2 * math.log(n0 + n1) + MARGIN)
    model.context = {r.word: (int(r.n0), int(r.n1)) for r in words.orderBy(F.desc("ratio"), "word").limit(MAX_CONTEXT).collect()}
    model.curve = fit(found, model)
    return model


def within(found: DataFrame, model: Model) -> DataFrame:
    """found without the matches that have more edits than tell something, and without rows that had no others."""
    limits = dict(zip(model.terms, model.limits(), strict=True))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.names.index("matches")
            kept = [[m for m in ms if m["distance"] <= limits[m["term"]]] for ms in batch.column(at).to_pylist()]
            return batch.set_column(at, "matches", pa.array(kept, batch.schema.field(at).type))

        return f

    return map_rows(found, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)).where(F.size("matches") > 0)


def fit(found: DataFrame, model: Model) -> np.ndarray:
    """Coefficients of features: logistic regression by Newton's steps, over FIT_ROWS rows with matches at most and the number of rows without."""
    total = sum(model.hits)
    part = min(1.0, 1.2 * FIT_ROWS / max(1, total))
    mixed = F.xxhash64("doc_id", "words", F.size("matches"))
    chosen = found.where(F.pmod(mixed, F.lit(1_000_003)) < part * 1_000_003).withColumn("h", mixed).orderBy("h").limit(FIT_ROWS)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            y, words, matches = (batch.column(i).to_pylist() for i in range(3))
            x = [model.features(w, [tuple(m.values()) for m in ms], a) for a, w, ms in zip(y, words, matches, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

        return f

    got = map_rows(chosen.select("y", "words", "matches"), make, "y int, x array<double>").toPandas()
    share = len(got) / total if total else 1.0
    x = np.array([*got.x.tolist(), *[[1.0, 0, 0, 0, 0]] * 2], float)
    y = np.array([*got.y.tolist(), 0, 1], float)
    without = [(model.rows[i] - model.hits[i]) * share + 0.5 for i in (0, 1)]
    weight = np.array([*[1.0] * len(got), *without])
    c = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.1 * np.array([0, 1, 1, 1, 1]) * c
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(c))
        move = np.linalg.solve(h, g)
        move *= min(1.0, 3 / max(1e-12, np.abs(move).max()))
        c -= move
        if np.abs(move).max() < 1e-8:
            break
    return c


def score(docs: DataFrame, model: Model, piece: int = PIECE) -> DataFrame:
    """All columns of docs but text, with score (0 to 1, higher: toxic likelier)."""
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    keep = [c for c in docs.columns if c != "text"]

    def make():
        finder = Finder(model.terms, model.limits(), piece)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            col = batch.schema.names.index
            got = finder.find([t.as_py() or "" for t in batch.column(col("text"))])
            return pa.RecordBatch.from_arrays([*(batch.column(col(c)) for c in keep), pa.array([model.score(*x) for x in got], pa.float64())], [*keep, "score"])

        return f

    return map_rows(docs, make, f"{_columns(docs)}score double")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("y")).where(~held_out() & F.col("y").isin(0, 1))
    # labels grow with the documents: a shuffled join at every size
    model = train(docs.where(~held_out()).join(labels.hint("merge"), "doc_id"))
    out = score(docs.withColumn("held_out", held_out()), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
