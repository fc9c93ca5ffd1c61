"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32, so that of two fingerprints that differ in two bits or fewer one segment differs in at most
one bit. Each fingerprint is indexed under its segments with one bit left out (a wildcard): 64 signatures. Fingerprints with an equal signature
are candidates; their true distance is verified. A bucket of many fingerprints is not paired up: its members are indexed again by signatures that
also leave bits of the other segment out. Those agree on 62 bits, so all members of such a group are linked, and one star of links stands for all pairs.

Defined cases: a null or wordless text has the fingerprint zero, linked like any other; a repeated row shares its fingerprint; a null doc_id stays
null and only counts as the smallest id where no other is there; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import map_rows, row_key, stored, table, unused
from entigraph.llm.components import components

SEED, WIDTH = 42, 3
#: Buckets of more fingerprints than this are indexed again instead of being paired up.
SMALL_BUCKET = 64


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Of one text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII blanks alone
    if not words:
        return 0
    flat, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size).tolist(), end.tolist()[min(width, len(words)) - 1 :]
    h = np.array([xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(first, last, strict=False)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def map_fingerprints(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows, columns of longs and last a text, with fp in the text's place."""
    names = rows.columns[:-1]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = pa.array([fingerprint(t.as_py(), width) for t in batch.columns[-1]], pa.int64())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], [*names, "fp"])

        return f

    return map_rows(rows, make, ", ".join(f"{n} long" for n in [*names, "fp"]))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp long) for every row of docs."""
    return map_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width)


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) over distinct fps (fp long) whose components are those of all pairs at two differing bits or fewer."""
    bit = "shiftleft(1L, {})".format
    # slot 0-31: the low segment without bit p; 32-63: the high segment without it. key: slot and the other 31 bits, exactly.
    spread = fps.select("fp", F.expr("explode(sequence(0, 63))").alias("slot")).select(
        "fp", "slot", F.expr("(cast(slot as bigint) << 32) | (case when slot < 32 then fp else fp >>> 32 end & 4294967295L & ~shiftleft(1L, slot % 32))").alias("key")
    )
    # counted with map-side combining and joined back in one way at every size: Spark can split a hot key of such a join, which a window over it can't be
    shared = stored(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    more = stored(spread.join(shared.hint("merge"), "key"), "simhash-shared")
    pairs = (
        more.where(f"n <= {SMALL_BUCKET}").groupBy("key", "slot").agg(F.collect_list("fp").alias("f"))
        # a pair with the segment equal is in 32 buckets: only the first emits it
        .select(F.expr("explode(flatten(transform(f, a -> transform(filter(f, b -> b > a and bit_count(a ^ b) <= 2 and (slot % 32 = 0 or (a ^ b) & shiftleft(1L, slot) <> 0)), b -> struct(a as u, b as v)))))").alias("p"))
        .select("p.u", "p.v").distinct()
    )
    # The other segment's bits: q alone beside the wildcard; with the segment equal (one slot is enough to see that), any two of them.
    one = "transform(sequence(0, 31), i -> struct(slot as p, if(slot < 32, 32, 0) + i as q))"
    pair = "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> struct(if(slot < 32, 32, 0) + i as p, if(slot < 32, 32, 0) + j as q))))"
    again = (
        more.where(f"n > {SMALL_BUCKET}")
        .select("fp", F.expr(f"explode(if(slot % 32 = 0, concat({one}, {pair}), {one}))").alias("w"))
        .select("fp", F.expr("least(w.p, w.q) * 64 + greatest(w.p, w.q)").alias("w"), F.expr(f"fp & ~({bit('w.p')} | {bit('w.q')})").alias("rest"))
    )
    again = stored(again.groupBy("w", "rest").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.collect_set("fp").alias("f")).where("u <> v"), "simhash-again")
    star = again.select("u", F.explode("f").alias("v")).where("u <> v")
    return pairs.union(star).distinct()


def first_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id (nulls last), of its texts and repeated rows one."""
    keys = {"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_t": row_key(F.col("text").cast("string"))}
    fps = map_fingerprints(docs.select(*[c.alias(n) for n, c in keys.items()], F.col("text").cast("string").alias("text")), width)
    rows = stored(fps, "simhash-fp")
    roots = components(links(rows.select("fp").distinct())).withColumnRenamed("node", "fp")
    first = rows.groupBy("fp").agg(F.min(F.struct("_d", "_t")).alias("first")).join(roots, "fp", "left")
    first = first.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first._d", "first._t")
    own = {n: unused(docs, n) for n in keys}  # the caller's columns stay as they are
    keyed = docs.withColumns({own[n]: c for n, c in keys.items()})
    return keyed.join(first.withColumnsRenamed(own), list(own.values())).dropDuplicates(list(own.values())).select(*docs.columns)


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable by links of at most two differing bits."""
    rows = stored(fingerprints(docs, width), "simhash-fp")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps.select("fp")))
    of = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
