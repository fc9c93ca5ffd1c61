"""Edges of many entities at once, neighbourhood cards, siblings and breadth-first walks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entigraph.operators.reach import FIRST, beyond, nearest
from entigraph.scratch import bucketed, stored


def _seeds(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("id").alias("seed")).where("seed is not null").distinct()


def _edges_of(seeds: DataFrame, edges: DataFrame, near: str, far: str, predicates, others: DataFrame | None, limit: int) -> DataFrame:
    if predicates is not None:
        edges = edges.where(F.col("predicate").isin(list(predicates)))
    out = edges.join(_seeds(seeds), F.col(near) == F.col("seed")).select("seed", "predicate", F.col(far).alias("node"))
    if others is not None:
        out = out.join(others.select(F.col("id").alias("node")), "node", "left_semi").select("seed", "predicate", "node")
    if limit:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("predicate", "node"))).where(F.col("n") <= limit).drop("n")
    return out


def outbound_edges(seeds: DataFrame, edges: DataFrame, predicates: Iterable[str] | None = None, targets: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """(seed, predicate, node) from seeds (id); predicates and targets (id, as of a class's instances) narrow; limit: edges of each seed, 0 for all."""
    return _edges_of(seeds, edges, "src", "dst", predicates, targets, limit)


def inbound_edges(seeds: DataFrame, edges: DataFrame, predicates: Iterable[str] | None = None, sources: DataFrame | None = None, limit: int = 0) -> DataFrame:
    return _edges_of(seeds, edges, "dst", "src", predicates, sources, limit)


def library_card(seeds: DataFrame, edges: DataFrame, axes: dict[str, dict]) -> DataFrame:
    """(seed, axis, predicate, node): several named views; each axis has direction (outbound, inbound), and predicates, others and limit as above."""
    def one(name: str, direction: str = "outbound", predicates=None, others=None, limit: int = 0) -> DataFrame:
        f = {"outbound": outbound_edges, "inbound": inbound_edges}[direction]
        return f(seeds, edges, predicates, others, limit).select("seed", F.lit(name).alias("axis"), "predicate", "node")

    return reduce(DataFrame.union, [one(name, **axis) for name, axis in axes.items()])


def directory(path: Column) -> Column:
    """The part of a path up to its last `/`, empty at the root."""
    return F.regexp_extract(path, "^(.*/)?", 0)


def siblings(seeds: DataFrame, rows: DataFrame, path: str, limit: int = 0) -> DataFrame:
    """(seed, node): rows in the same directory as a seed, itself left out; rows at the root are each other's siblings. With a limit each directory is cut to its
    first limit + 1 rows before it meets its seeds, so that a large one costs a seed no more than a small one."""
    placed = rows.select("id", directory(F.col(path)).alias("dir")).where(F.col(path).isNotNull())
    asked = placed.join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("seed"), "dir")
    if limit:
        placed = placed.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("id"))).where(F.col("n") <= limit + 1).drop("n")
    out = placed.join(asked, "dir").where("id <> seed").select("seed", F.col("id").alias("node"))
    if limit:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("n") <= limit).drop("n")
    return out


def sibling_groups(seeds: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """(dir, id, is_seed): the rows of each directory that holds a seed, once each, whatever the number of its seeds. What siblings() says, without the pairs."""
    placed = rows.select("id", directory(F.col(path)).alias("dir")).where(F.col(path).isNotNull())
    marked = placed.join(seeds.select("id").distinct().withColumn("is_seed", F.lit(True)), "id", "left").select("dir", "id", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))
    return marked.join(marked.where("is_seed").select("dir").distinct(), "dir", "left_semi")


def graph_walk(seeds: DataFrame, edges: DataFrame, hops: int | None = 4, direction: str = "forward", predicates: Iterable[str] | None = None, paths: bool = False) -> DataFrame:
    """(seed, node, hop) of all nodes within some hops (None: all), each at its fewest, seeds left out; paths adds its least shortest path as steps.

    direction: forward, inverse or both. A round joins only what the last one found. Rounds are written to the shared folder, in buckets by (seed, node): what is new is moved once and
    held against each earlier round where that lies. Without paths, what is further than the first steps
    is found by doubling (see reach)."""
    if predicates is not None:
        edges = edges.where(F.col("predicate").isin(list(predicates)))
    way = lambda a, b, d: edges.select(F.col(a).alias("node"), F.struct("predicate", F.lit(d).alias("direction"), F.col(b).alias("node")).alias("step"))
    ways = {"forward": [("src", "dst", "forward")], "inverse": [("dst", "src", "inverse")], "both": [("src", "dst", "forward"), ("dst", "src", "inverse")]}[direction]
    steps = reduce(DataFrame.union, [way(*w) for w in ways])
    if hops != 1:  # each round reads it: what makes the edges runs once
        steps = stored(steps, "walk-steps")
    new = _seeds(seeds).select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    if paths:
        new = new.withColumn("path", F.array().cast("array<struct<predicate:string,direction:string,node:string>>"))
    seen, out, hop = [], None, 0
    while hops is None or hop < hops:
        if hop == FIRST and not paths:
            far = beyond(new, steps.select("node", F.col("step.node").alias("to"))).where("node <> seed")
            return nearest(out.union(far if hops is None else far.where(F.col("hop") <= hops)))
        hop += 1
        found = new.join(steps, "node").select("seed", F.col("step.node").alias("node"), *([F.concat("path", F.array("step")).alias("path")] if paths else []))
        found = found.where("node <> seed")
        found = found.groupBy("seed", "node").agg(F.min("path").alias("path")) if paths else found.distinct()
        for earlier in seen:
            found = found.join(earlier.select("seed", "node"), ["seed", "node"], "left_anti")
        new = bucketed(found.select("seed", "node", F.lit(hop).alias("hop"), *(["path"] if paths else [])), "walk", "seed", "node")
        out = new if out is None else out.union(new)
        if new.isEmpty():
            break
        seen.append(new)
    return out if out is not None else new.limit(0)


def realize_bundle(seeds: DataFrame, rows: DataFrame, edges: DataFrame, predicates: Iterable[str]) -> DataFrame:
    """rows (id, ...) of the seeds and of everything that they reach by some predicates, once each."""
    reached = graph_walk(seeds, edges, None, "forward", predicates).select(F.col("node").alias("id"))
    return rows.join(reached.union(seeds.select("id")).distinct(), "id", "left_semi")


def section_chain(sections: DataFrame, following: str = "next_sibling") -> DataFrame:
    """(head, id, ord): sections in the order of their chain of next siblings; a head is nobody's next, and chains without one are left out.

    Each section's pointer to one before it is doubled until it is the head: a round for each doubling of the longest chain, not for each link."""
    links = sections.select(F.col("id").alias("to"), F.col(following).alias("id")).where("id is not null").distinct()
    heads = sections.select("id").distinct().join(links, "id", "left_anti")
    now = links.join(heads.select(F.col("id").alias("to"), F.lit(True).alias("done")), "to", "left")
    now = stored(now.select("id", "to", F.lit(1).alias("d"), F.coalesce("done", F.lit(False)).alias("done")), "chain")
    out, left = now.where("done"), -1
    while (n := now.where("not done").count()) and n != left:
        left = n
        further = now.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("d").alias("more"), F.col("done").alias("there"))
        moved = now.where("not done").join(further, "to").select("id", F.col("beyond").alias("to"), (F.col("d") + F.col("more")).alias("d"), F.col("there").alias("done"))
        now = stored(moved.unionByName(now.where("done")).groupBy("id", "to", "done").agg(F.min("d").alias("d")).select("id", "to", "d", "done"), "chain")
        out = now.where("done")
    return heads.select(F.col("id").alias("head"), "id", F.lit(0).alias("ord")).union(out.select(F.col("to").alias("head"), "id", F.col("d").alias("ord")))
