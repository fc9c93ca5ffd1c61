"""A path algebra over typed edges, applied to all seeds at once.

Expressions are Python objects: P("placed_by"), Seq(...), Or(...), Plus(...), Star(...), Opt(...), Rep(a, m, n), Inv(...), Self(), Any(), Not(...),
and filters of the current node: Restrict(slot, value), Filter(a, text), Test(a, name). follow() evaluates one from a DataFrame of seeds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.graph import TypedGraph
from entigraph.operators.reach import FIRST, beyond
from entigraph.scratch import stored

MAX_ROUNDS = 10_000
#: Steps of a repetition between two writes of what was found.
STEPS_A_ROUND = 3
STEPS = "array<struct<predicate:string,direction:string,node:string>>"

#: Named tests of a node's id, for Test.
TESTS: dict[str, Callable[[Column], Column]] = {}


def register_test(name: str, rule: Callable[[Column], Column]) -> None:
    TESTS[name] = rule


for _name, _rule in {
    "some?": lambda c: c.isNotNull(), "nil?": lambda c: c.isNull(), "string?": lambda c: c.isNotNull(), "keyword?": lambda c: c.rlike("^:?[^/]+/.+$"),
    "blank?": lambda c: F.trim(c) == "", "empty?": lambda c: F.length(c) == 0, "not-empty?": lambda c: F.length(c) > 0, "uuid?": lambda c: c.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
    "number?": lambda c: c.try_cast("double").isNotNull(), "integer?": lambda c: c.try_cast("bigint").isNotNull(), "even?": lambda c: F.regexp_extract(c, "([0-9]+)$", 1).try_cast("bigint") % 2 == 0,
    "odd?": lambda c: F.regexp_extract(c, "([0-9]+)$", 1).try_cast("bigint") % 2 == 1, "pos?": lambda c: F.regexp_extract(c, "(-?[0-9]+)$", 1).try_cast("bigint") > 0,
    "zero?": lambda c: F.regexp_extract(c, "([0-9]+)$", 1).try_cast("bigint") == 0, "any?": lambda c: F.lit(True), "neg?": lambda c: F.regexp_extract(c, "(-?[0-9]+)$", 1).try_cast("bigint") < 0,
    "true?": lambda c: c == "true", "false?": lambda c: c == "false", "not-empty": lambda c: F.length(c) > 0, "coll?": lambda c: F.lit(False), "map?": lambda c: F.lit(False),  # an id is a string
}.items():
    register_test(_name, _rule)


@dataclass(frozen=True)
class Context:
    graph: TypedGraph
    edges: DataFrame
    paths: bool

    def once(self, rel: DataFrame, rank: str | None = None) -> DataFrame:
        """One row for each (seed, node): with paths that of the least rank, the fewest steps, then the first by names."""
        if not self.paths:
            return rel.select("seed", "node").distinct()
        order = F.struct(*([rank] if rank else []), F.size("path"), "path")
        return rel.groupBy("seed", "node").agg(F.min_by("path", order).alias("path"))


class Path:
    def step(self, c: Context, rel: DataFrame) -> DataFrame:
        raise NotImplementedError

    def inverse(self) -> Path:
        return self


@dataclass(frozen=True)
class Step(Path):
    """Along edges: of some predicates (None: any), or of all others."""

    predicates: tuple[str, ...] | None
    others: bool = False
    back: bool = False

    def step(self, c, rel):
        e = c.edges
        if self.predicates is not None:
            hit = F.col("predicate").isin(list(self.predicates))
            e = e.where(~hit if self.others else hit)
        a, b = ("dst", "src") if self.back else ("src", "dst")
        e = e.select(F.col(a).alias("node"), F.struct("predicate", F.lit("inverse" if self.back else "forward").alias("direction"), F.col(b).alias("node")).alias("step"))
        out = rel.join(e, "node")
        return c.once(out.select("seed", F.col("step.node").alias("node"), *([F.concat("path", F.array("step")).alias("path")] if c.paths else [])))

    def inverse(self):
        return replace(self, back=not self.back)


def P(predicate: str) -> Path:
    return Step((predicate,))


def Any() -> Path:
    return Step(None)


def Not(*predicates: str) -> Path:
    if not predicates or not all(isinstance(p, str) for p in predicates):
        raise ValueError("Not takes names of predicates")
    return Step(tuple(predicates), others=True)


@dataclass(frozen=True)
class Self(Path):
    def step(self, c, rel):
        return rel


@dataclass(frozen=True)
class _Seq(Path):
    parts: tuple[Path, ...]

    def step(self, c, rel):
        for p in self.parts:
            rel = p.step(c, rel)
        return rel

    def inverse(self):
        return _Seq(tuple(p.inverse() for p in reversed(self.parts)))


def Seq(*parts: Path) -> Path:
    flat = [q for p in parts for q in (p.parts if isinstance(p, _Seq) else (p,)) if not isinstance(q, Self)]
    return flat[0] if len(flat) == 1 else _Seq(tuple(flat)) if flat else Self()


@dataclass(frozen=True)
class _Or(Path):
    parts: tuple[Path, ...]

    def step(self, c, rel):
        out = None
        for i, p in enumerate(self.parts):
            got = p.step(c, rel).withColumn("rank", F.lit(i))
            out = got if out is None else out.unionByName(got)
        return c.once(out, "rank")

    def inverse(self):
        return _Or(tuple(p.inverse() for p in self.parts))


def Or(*parts: Path) -> Path:
    flat = list(dict.fromkeys(q for p in parts for q in (p.parts if isinstance(p, _Or) else (p,))))
    return flat[0] if len(flat) == 1 else _Or(tuple(flat))


def _predicates(p: Path) -> set[str] | None:
    """All that an expression follows; None: any."""
    if isinstance(p, Step):
        return None if p.others or p.predicates is None else set(p.predicates)
    out: set[str] = set()
    for q in getattr(p, "parts", None) or ([p.part] if hasattr(p, "part") else []):
        got = _predicates(q)
        if got is None:
            return None
        out |= got
    return out


@dataclass(frozen=True)
class _Repeat(Path):
    """At least m steps, at most n (None: until nothing new)."""

    part: Path
    m: int
    n: int | None

    def step(self, c, rel):
        if self.n is None:
            return self._all(c, rel)
        out, now = (rel.withColumn("rank", F.lit(0)) if self.m == 0 else None), rel
        for k in range(1, self.n + 1):
            now = self.part.step(c, now)
            if k >= self.m:
                level = now.withColumn("rank", F.lit(k))
                out = level if out is None else out.unionByName(level)
        return c.once(out, "rank")

    def _all(self, c, rel):
        used = _predicates(self.part)
        c = replace(c, edges=stored(c.edges if used is None else c.edges.where(F.col("predicate").isin(sorted(used))), "path-edges"))
        new = rel = stored(rel, "path")
        seen = rel if self.m == 0 else None
        for k in range(MAX_ROUNDS):
            if k * STEPS_A_ROUND >= FIRST and not c.paths:  # a long way: doubled, from here on
                nodes = c.edges.select(F.col("src").alias("seed")).union(c.edges.select(F.col("dst").alias("seed"))).distinct()
                links = self.part.step(c, nodes.select("seed", F.col("seed").alias("node"))).select(F.col("seed").alias("node"), F.col("node").alias("to"))
                far = beyond(new.select("seed", "node", F.lit(0).alias("hop")), links)
                return c.once(seen.unionByName(far.select("seed", "node")))
            found, now = None, new
            for k in range(STEPS_A_ROUND):
                now = self.part.step(c, now)
                level = now.withColumn("rank", F.lit(k))
                found = level if found is None else found.unionByName(level)
            found = c.once(found, "rank")
            if seen is not None:
                found = found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
            new = stored(found, "path")
            if new.isEmpty():
                return seen if seen is not None else new
            seen = new if seen is None else seen.unionByName(new)
        raise RuntimeError(f"no end of the repetition after {MAX_ROUNDS} rounds")

    def inverse(self):
        return replace(self, part=self.part.inverse())


def Plus(a: Path) -> Path:
    return a if isinstance(a, _Repeat) and a.n is None else _Repeat(a, 1, None)


def Star(a: Path) -> Path:
    return _Repeat(a.part if isinstance(a, _Repeat) and a.n is None else a, 0, None)


def Opt(a: Path) -> Path:
    return Star(a.part) if isinstance(a, _Repeat) and a.n is None else _Repeat(a, 0, 1)


def Rep(a: Path, m: int, n: int) -> Path:
    if not 0 <= m <= n:
        raise ValueError("0 <= m <= n is needed")
    return _Repeat(a, m, n) if n else Self()


def Inv(a: Path) -> Path:
    return a.inverse()


@dataclass(frozen=True)
class Restrict(Path):
    """Keeps the node if its slot has the value."""

    slot: str
    value: object

    def step(self, c, rel):
        g, hits = c.graph, None
        for name in g.sources:
            if any(s.name == self.slot for s in g.registry.slots_of(name)) and self.slot in g.sources[name].columns:
                ids = g.where(name, (self.slot, "=", self.value), slots=[self.slot]).select(F.col("id").alias("node"))
                hits = ids if hits is None else hits.union(ids)
        if hits is None:
            raise ValueError(f"no class has a slot {self.slot}")
        return rel.join(hits, "node", "left_semi")


@dataclass(frozen=True)
class Filter(Path):
    """Keeps what a reaches if its ident (else nothing) contains a text."""

    part: Path
    text: str

    def step(self, c, rel):
        idents = None
        for name in c.graph.sources:
            if "ident" in c.graph.sources[name].columns:
                ids = c.graph.scan_class(name, []).where(F.col("ident").contains(self.text)).select(F.col("id").alias("node"))
                idents = ids if idents is None else idents.union(ids)
        got = self.part.step(c, rel)
        return got.limit(0) if idents is None else got.join(idents, "node", "left_semi")

    def inverse(self):
        return replace(self, part=self.part.inverse())


@dataclass(frozen=True)
class Test(Path):
    """Keeps what a reaches if a registered test of the node's id holds."""

    part: Path
    name: str

    def step(self, c, rel):
        if self.name not in TESTS:
            raise ValueError(f"no test named {self.name}")
        return self.part.step(c, rel).where(TESTS[self.name](F.col("node")))

    def inverse(self):
        return replace(self, part=self.part.inverse())


def follow(graph: TypedGraph, seeds: DataFrame, via: Path, paths: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """(seed, node) reached from seeds (id) by a path, once each; paths adds path: struct of nodes and edges (predicate, direction)."""
    rel = seeds.select(F.col("id").alias("seed")).where("seed is not null").distinct().select("seed", F.col("seed").alias("node"))
    if paths:
        rel = rel.withColumn("path", F.array().cast(STEPS))
    c = Context(graph, graph.edges() if edges is None else edges, paths)
    out = c.once(via.step(c, rel))
    if not paths:
        return out
    nodes = F.concat(F.array("seed"), F.transform("path", lambda s: s["node"]))
    steps = F.transform("path", lambda s: F.struct(s["predicate"].alias("predicate"), s["direction"].alias("direction")))
    return out.select("seed", "node", F.struct(nodes.alias("nodes"), steps.alias("edges")).alias("path"))


def missing_seeds(seeds: DataFrame, ids: DataFrame) -> DataFrame:
    """Seeds (id) that no entity has."""
    return seeds.select("id").distinct().join(ids.select("id"), "id", "left_anti")


# Tables of paths: a column `path` as follow() gives it.


def path_facts(rows: DataFrame) -> DataFrame:
    p = lambda f: F.col(f"path.{f}")
    return rows.withColumns({
        "length": F.size(p("edges")), "start": F.element_at(p("nodes"), 1), "end": F.element_at(p("nodes"), -1),
        "predicates": F.transform(p("edges"), lambda e: e["predicate"]), "directions": F.transform(p("edges"), lambda e: e["direction"]),
        "valid": F.size(p("nodes")) == F.size(p("edges")) + 1,
    })


def node_at(i: Column) -> Column:
    return F.get("path.nodes", i)


def edge_at(i: Column) -> Column:
    return F.get("path.edges", i)


def extend(predicate: Column, direction: Column, node: Column) -> Column:
    edge = F.struct(predicate.alias("predicate"), direction.alias("direction"))
    return F.struct(F.concat("path.nodes", F.array(node)).alias("nodes"), F.concat("path.edges", F.array(edge)).alias("edges"))


def concat_paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path): each of the first followed by each of the second that starts where it ends."""
    a = first.select(F.col("path").alias("a"), F.element_at("path.nodes", -1).alias("at"))
    b = second.select(F.col("path").alias("b"), F.element_at("path.nodes", 1).alias("at"))
    nodes = F.concat("a.nodes", F.slice("b.nodes", F.lit(2), F.size("b.nodes")))
    return a.join(b, "at").select(F.struct(nodes.alias("nodes"), F.concat("a.edges", "b.edges").alias("edges")).alias("path"))


def reverse_path() -> Column:
    turned = F.transform(F.reverse("path.edges"), lambda e: F.struct(e["predicate"].alias("predicate"), F.when(e["direction"] == "forward", "inverse").otherwise("forward").alias("direction")))
    return F.struct(F.reverse("path.nodes").alias("nodes"), turned.alias("edges"))


def _parts(short: DataFrame, long: DataFrame, kind: str) -> DataFrame:
    """Equality of lengths and hashes: each long path has a hash for each length that short ones have (at its beginning, its end or each place), and is then compared with those it meets."""
    sizes = [(r.m, r.n) for r in short.select(F.size("path.nodes").alias("m"), F.size("path.edges").alias("n")).distinct().collect()]  # no more than the longest path is long
    s = short.select(F.col("path").alias("short"), F.size("path.nodes").alias("m"), F.size("path.edges").alias("n"), F.xxhash64("path.nodes", "path.edges").alias("h"))
    if not sizes:
        return s.select("short", F.col("short").alias("long")).limit(0)
    x = long.select(F.col("path").alias("long"), F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m, n in sizes])).alias("s")).select("long", "s.*")
    last = F.size("long.nodes") - F.col("m")
    x = x.where((last >= 0) & (F.size("long.edges") >= F.col("n")))
    place = {"prefix": F.array(F.lit(0)), "suffix": F.array(last), "subpath": F.sequence(F.lit(0), last)}[kind]
    x = x.select("*", F.explode(place).alias("i"))
    part = lambda f, size: F.slice(f"long.{f}", F.col("i") + 1, F.col(size))
    both = x.withColumn("h", F.xxhash64(part("nodes", "m"), part("edges", "n"))).join(s, ["m", "n", "h"])
    return both.where((part("nodes", "m") == F.col("short.nodes")) & (part("edges", "n") == F.col("short.edges"))).select("short", "long").distinct()


def prefixes(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): pairs of two path tables of which one begins the other."""
    return _parts(short, long, "prefix")


def suffixes(short: DataFrame, long: DataFrame) -> DataFrame:
    return _parts(short, long, "suffix")


def subpaths(short: DataFrame, long: DataFrame) -> DataFrame:
    return _parts(short, long, "subpath")
