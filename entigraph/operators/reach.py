"""Reachability in rounds that grow with the logarithm of the longest chain, not with its length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entigraph.scratch import stored

#: Steps that walks and closures take one by one before they double: most end by then, and touch only what their seeds do.
FIRST = 6
#: Pairs that are a number of steps apart may be so many times the links.
GROWTH = 4
#: Doublings between two writes of what was reached.
BATCH = 4
MAX_ROUNDS = 10_000


def nearest(found: DataFrame) -> DataFrame:
    """(seed, node, hop), each pair at its fewest hops."""
    return found.groupBy("seed", "node").agg(F.min("hop").alias("hop"))


def _along(found: DataFrame, links: DataFrame, steps: int) -> DataFrame:
    return found.join(links, "node").select("seed", F.col("to").alias("node"), (F.col("hop") + steps).alias("hop"))


def _twice(links: DataFrame, most: int) -> DataFrame | None:
    """links followed by links, or None if that may be more than `most` pairs: their number is known before any is made."""
    ends = links.groupBy(F.col("to").alias("at")).agg(F.count("*").alias("n")).join(links.groupBy(F.col("node").alias("at")).agg(F.count("*").alias("m")), "at")
    if (ends.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0) > most:
        return None
    return stored(links.select("node", F.col("to").alias("at")).join(links.select(F.col("node").alias("at"), "to"), "at").select("node", "to").distinct(), "reach-links")


def beyond(start: DataFrame, links: DataFrame) -> DataFrame:
    """start (seed, node, hop), all of one hop, with everything that links (node, to) lead to from there, each pair at its fewest hops.

    Links are doubled: pairs 1, 2, 4, ... steps apart, whatever lies between. What is reached in fewer than 2 ** k steps, with what is 2 ** k steps further, is all that is reached in fewer
    than 2 ** (k + 1). In chains, trees and cycles the doubled links are never more than the links. Where they would grow beyond GROWTH times these, in dense parts, whose diameters are
    small, the walk goes on in strides of the last doubling, from what the last stride found. It ends when a batch finds nothing new."""
    links = stored(links.select("node", "to").where("node is not null and to is not null").distinct(), "reach-links")
    most, stride = GROWTH * max(1, links.count()), 1
    reached = stored(nearest(start), "reach")
    first, had = reached.agg(F.min("hop")).first()[0], reached.count()
    if first is None:
        return reached
    growing = True
    while growing:
        for _ in range(BATCH):
            reached = nearest(reached.union(_along(reached, links, stride)))
            if (further := _twice(links, most)) is None:
                growing = False
                break
            links, stride = further, 2 * stride
        reached = stored(reached, "reach")
        now = reached.count()
        if now == had:
            return reached
        had = now
    # everything in fewer than `covered` steps is there; the last stride's finds are the front
    covered = 2 * stride
    front = reached.where(F.col("hop") >= first + covered - stride)
    for _ in range(MAX_ROUNDS):
        front = stored(nearest(_along(front, links, stride)).join(reached.select("seed", "node"), ["seed", "node"], "left_anti"), "reach")
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
    raise RuntimeError(f"no end after {MAX_ROUNDS} strides of {stride} steps")
