"""A typed graph over class tables: polymorphic scans and the edges that references make."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.model import TypeRegistry

EDGES = "src string, predicate string, dst string"


class Sources(Mapping):
    """Class tables that are opened when they are asked for: a query over two classes reads the schemas of two."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def __contains__(self, name) -> bool:
        return name in self.makers


class TypedGraph:
    """sources: a DataFrame for each concrete class with id, the class's slots (any may be absent) and perhaps ident."""

    def __init__(self, spark: SparkSession, registry: TypeRegistry, sources: Mapping[str, DataFrame]) -> None:
        self.spark, self.registry, self.sources = spark, registry, sources
        self.tests: dict = {}

    def scan_class(self, name: str, slots: Iterable[str] | None = None) -> DataFrame:
        """Direct instances, with the class's effective slots or those asked for."""
        wanted = None if slots is None else set(slots)
        columns = [f for f in self.registry.struct_of(name) if f.name in ("id", "ident", "class") or wanted is None or f.name in wanted]
        if name not in self.sources:
            return self.spark.createDataFrame([], "id string, ident string, class string").select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("id", "ident", "class") else F.col(f.name) for f in columns])
        df = self.sources[name]

        def one(f) -> Column:
            if f.name == "class":
                return F.lit(name).alias("class")
            if f.name not in df.columns:
                return F.lit(None).cast(f.dataType).alias(f.name)
            return F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)

        return df.select(*map(one, columns))

    def scan_instances(self, name: str, slots: Iterable[str] | None = None) -> DataFrame:
        """Instances of a class and of all classes below it; slots that a class lacks are null. Ask for slots to read only their columns."""
        slots = None if slots is None else list(slots)
        parts = [self.scan_class(c, slots) for c in self.registry.family(name) if c in self.sources]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else self.scan_class(name, slots)

    def scan_classes(self, names: Iterable[str] | None = None) -> DataFrame:
        """Instances of several classes (all concrete ones)."""
        names = list(names) if names is not None else [c for c in self.sources if not self.registry.classes[c].abstract]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.scan_class(c) for c in names])

    def class_counts(self, names: Iterable[str] | None = None) -> DataFrame:
        """(class, n), and the total in the row whose class is null."""
        names = list(names) if names is not None else list(self.sources)
        ids = reduce(DataFrame.unionByName, [self.scan_class(c, []).select("class") for c in names])
        return ids.rollup("class").agg(F.count("*").alias("n"))

    def scan_named(self, name: str) -> DataFrame:
        return self.scan_instances(name).where(F.col("ident").isNotNull())

    def edges(self, predicates: Iterable[str] | None = None, include_type: bool = False, near: str | None = None) -> DataFrame:
        """(src, predicate, dst) of every reference slot of every class table, or of some predicates; include_type adds (id, type, class).

        Ids are taken to be unique: an id that stands in two rows has its edges twice; the values of a many-valued slot are told once. near: only references
        from or to instances of a class or of those below it, as the class model allows; other tables and slots are not read."""
        wanted, parts = None if predicates is None else set(predicates), []
        close = None if near is None else set(self.registry.family(near))
        for c in self.sources:
            refs = [s for s in self.registry.slots_of(c) if s.is_ref and (wanted is None or s.name in wanted) and (close is None or c in close or self._meets(s.range, close))]
            typed = include_type and (wanted is None or "type" in wanted) and (close is None or c in close)
            parts += self._edges_of(c, refs)
            if typed:
                parts.append(self.sources[c].select(F.col("id").alias("src"), F.lit("type").alias("predicate"), F.lit(c).alias("dst")))
        return self._union(parts)

    def edges_within(self, name: str, hops: int, direction: str = "forward", predicates: Iterable[str] | None = None) -> DataFrame:
        """The edges that a walk of so many hops from instances of a class can take, by the class model: a table is read if it lies within reach."""
        wanted = None if predicates is None else set(predicates)
        all_refs = [(c, s) for c in self.sources for s in self.registry.slots_of(c) if s.is_ref and (wanted is None or s.name in wanted)]
        reached, taken = set(self.registry.family(name)), set()
        for _ in range(hops):
            new = set()
            for c, s in all_refs:
                if direction != "inverse" and c in reached:
                    taken.add((c, s.name))
                    new |= set(self.registry.family(s.range))
                if direction != "forward" and self._meets(s.range, reached):
                    taken.add((c, s.name))
                    new.add(c)
            reached |= new
        return self._union([e for c in self.sources for e in self._edges_of(c, [s for d, s in all_refs if d == c and (c, s.name) in taken])])

    def _meets(self, range_: str, classes: set[str]) -> bool:
        return not classes.isdisjoint(self.registry.family(range_))

    def _edges_of(self, name: str, refs: list) -> list[DataFrame]:
        df, out = self.sources[name] if refs else None, []
        for s in refs:
            if s.name in df.columns:
                dst = F.explode(F.array_distinct(s.name)) if s.many else F.col(s.name)
                out.append(df.select(F.col("id").alias("src"), F.lit(s.name).alias("predicate"), dst.alias("dst")).where(F.col("dst").isNotNull()))
        return out

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], EDGES)

    def where(self, name: str, *clauses, slots: Iterable[str] | None = None) -> DataFrame:
        """Instances that meet all clauses: Columns, or (slot, op, value) with op one of = != < <= > >= in contains exists missing.

        On a many-valued slot `=` and `in` ask whether a value is among the slot's."""
        return filtered(self.scan_instances(name, slots), *clauses)

    def join_ref(self, df: DataFrame, slot: str, target: str, prefix: str = "") -> DataFrame:
        """df joined through a reference slot to the target class's rows, whose columns get the prefix."""
        t = self.scan_instances(target)
        t = t.select(*[F.col(c).alias(f"{prefix}{c}") for c in t.columns])
        return df.join(t, df[slot] == t[f"{prefix}id"])

    def instance_of(self, df: DataFrame, name: str, column: str = "id") -> DataFrame:
        """Rows whose id column names an instance of the class or of one below it."""
        ids = self.scan_instances(name, []).select(F.col("id").alias(column))
        return df.join(ids, column, "left_semi")


def filtered(df: DataFrame, *clauses) -> DataFrame:
    for c in clauses:
        if isinstance(c, Column):
            df = df.where(c)
            continue
        slot, op, *value = c
        v, x = value[0] if value else None, F.col(slot)
        many = df.schema[slot].dataType.typeName() == "array"
        if op == "=":
            df = df.where(F.array_contains(x, F.lit(v)) if many else x == F.lit(v))
        elif op == "!=":
            df = df.where(x != F.lit(v))
        elif op == "in":
            df = df.where(F.arrays_overlap(x, F.array(*map(F.lit, v))) if many else x.isin(list(v)))
        elif op == "contains":
            df = df.where(x.contains(v))
        elif op == "exists":
            df = df.where(x.isNotNull())
        elif op == "missing":
            df = df.where(x.isNull())
        else:
            df = df.where({"<": x < F.lit(v), "<=": x <= F.lit(v), ">": x > F.lit(v), ">=": x >= F.lit(v)}[op])
    return df


def project(df: DataFrame, slots: Iterable[str]) -> DataFrame:
    """id, ident and some slots."""
    return df.select("id", "ident", *slots)
