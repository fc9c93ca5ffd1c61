"""Language identification by rank-order profiles of n-grams.

A profile is a language's PROFILE most frequent n-grams of one to three letters (words stand between boundaries), in order. A document's own most
frequent n-grams are compared to each profile by the out-of-place distance: how far each stands from its place there, PROFILE if it is not in it.
The nearest language wins; ties go to the first by name.

Profiles are counted over all rows that may be learned from. They are a fixed number of n-grams for each language.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without a language are not learned from; with nothing to learn from
every text is `und`; a null doc_id is not held out; repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entigraph.llm.common import map_rows, table

PROFILE = 400
#: More languages than this are refused: the profiles go to every task.
MAX_LANGUAGES = 2000
#: Letters counted at once while learning.
CHUNK = 2_000_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normal(text: str) -> np.ndarray:
    """Lower-case code points of letters; each run of others is one 1, and there is one at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(_letters()[c], c, 1).astype(np.uint64)
    c = np.concatenate((np.ones(1, np.uint64), c, np.ones(1, np.uint64)))
    return c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]


def grams(c: np.ndarray) -> np.ndarray:
    """One to three letters packed in 63 bits; a boundary counts as a letter at the ends only."""
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 1]
    return np.concatenate((c[c != 1], two, three)).astype(np.int64) if len(c) > 2 else np.zeros(0, np.int64)


def top(text: str, size: int = PROFILE) -> np.ndarray:
    """A document's most frequent n-grams, most frequent first, ties by number."""
    g, n = np.unique(grams(normal(text)), return_counts=True)
    if len(g) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        g, n = g[n >= least], n[n >= least]
    return g[np.lexsort((g, -n))][:size]


def learn(docs: DataFrame, size: int = PROFILE) -> list[tuple[str, list[int]]]:
    """(lang, its n-grams in order) by name, from the rows of docs (lang, text) that have a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list] = {}
            held = 0

            def out():
                for lang, c in parts.items():
                    g, n = np.unique(grams(np.concatenate(c)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = normal(text.as_py() or "")
                if lang in parts:
                    parts[lang].append(c[1:])  # its boundary is that of the text before
                else:
                    parts[lang] = [c]
                held += len(c)
                if held > CHUNK:
                    yield from out()
                    parts, held = {}, 0
            yield from out()

    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    # at most `size` n-grams of each language come here; one row a language more than allowed is enough to refuse
    got = best.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gram"))), lambda s: s["gram"]).alias("grams")).limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return sorted((r.lang, list(r.grams)) for r in got)


class Profiles:
    def __init__(self, learned: list[tuple[str, list[int]]], size: int = PROFILE) -> None:
        self.langs, self.size = [lang for lang, _ in learned], size
        self.grams = np.unique(np.array([g for _, gs in learned for g in gs], np.int64))
        self.rank = np.full((len(self.grams) + 1, len(learned)), -1, np.int32)  # the last row: in no profile
        for k, (_, gs) in enumerate(learned):
            self.rank[np.searchsorted(self.grams, gs), k] = np.arange(len(gs))

    def best(self, text: str | None) -> tuple[str, float]:
        own = top(text, self.size) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = self.rank[np.where(self.grams[at] == own, at, len(self.grams))]
        far = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        k = int(far.argmin())
        return self.langs[k], 1 - float(far[k]) / (self.size * len(own))


def predict(docs: DataFrame, learned: list[tuple[str, list[int]]], size: int = PROFILE) -> DataFrame:
    """(all columns of docs, lang_pred, score): score is 1 less the distance as a part of the greatest possible one."""

    def make():
        p = Profiles(learned, size)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [p.best(t.as_py()) for t in batch.column(batch.schema.names.index("text"))]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

        return f

    docs = docs.drop("lang_pred", "score")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, make, f"{columns}, lang_pred string, score double")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = learn(docs.where(~held_out()).select("lang", "text"))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")), learned).select("doc_id", "held_out", "lang_pred", "score")
