"""Entities as JSON and CSV, slot coercion, references, and bulk writes to new versions of tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entigraph.functions.text import keyword
from entigraph.model import Slot, TypeRegistry
from entigraph.operators.validate import row_errors


def _keys(registry: TypeRegistry, name: str, aliases: dict[str, str] | None) -> dict[str, str]:
    """Slot by JSON key: aliases given, the class's own, or the slot's name."""
    own = {**{s.name: s.name for s in registry.slots_of(name)}, "id": "id", "ident": "ident"}
    for key, slot in {**registry.classes[name].aliases, **(aliases or {})}.items():
        own.pop(slot, None)
        own[key] = slot
    return own


def read_entities_json(spark: SparkSession, path: str, registry: TypeRegistry, name: str, aliases: dict[str, str] | None = None, class_key: str = "_class") -> DataFrame:
    """Rows of a class from JSON lines or arrays of objects; other classes' records are left out, as are keys that are no slot."""
    keys = _keys(registry, name, aliases)
    kind = {f.name: f.dataType for f in registry.struct_of(name)}
    schema = T.StructType([T.StructField(k, kind[s]) for k, s in keys.items() if s in kind] + [T.StructField(class_key, T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", False).json(path)
    return rows.where(F.col(class_key) == name).select(*[F.col(f"`{k}`").alias(s) for k, s in keys.items() if s in kind])


def entity_json(rows: DataFrame, registry: TypeRegistry, name: str, aliases: dict[str, str] | None = None, class_key: str = "_class") -> Column:
    """One JSON object: the class, then slots under their short keys; unset slots and internal columns are left out."""
    keys = {s: k for k, s in _keys(registry, name, aliases).items()}
    columns = [F.col(c).alias(keys[c]) for c in rows.columns if c in keys]
    return F.to_json(F.struct(F.lit(name).alias(class_key), *columns))


def write_entities_json(rows: DataFrame, path: str, registry: TypeRegistry, name: str, aliases: dict[str, str] | None = None) -> None:
    rows.select(entity_json(rows, registry, name, aliases).alias("value")).write.text(path)


def write_entities(rows: DataFrame, path: str, registry: TypeRegistry, name: str) -> None:
    """Rows of a class in its own format: json, csv or parquet; its aliases are the keys of JSON objects."""
    kind = registry.classes[name].format or "json"
    if kind == "json":
        write_entities_json(rows, path, registry, name)
    elif kind == "csv":
        write_csv_rows(rows, path)
    elif kind == "parquet":
        rows.write.parquet(path)
    else:
        raise ValueError(f"{name}: no format {kind}")


def read_entities(spark: SparkSession, path: str, registry: TypeRegistry, name: str) -> DataFrame:
    """What write_entities() wrote, with the class's types."""
    kind = registry.classes[name].format or "json"
    if kind == "json":
        return read_entities_json(spark, path, registry, name)
    rows = {"csv": read_csv_rows, "parquet": lambda s, p: s.read.parquet(p)}[kind](spark, path)
    if kind == "csv":
        many = {s.name for s in registry.slots_of(name) if s.many}
        rows = rows.select(*[F.from_json(c, "array<string>").alias(c) if c in many else F.col(c) for c in rows.columns])
        types = {f.name: f.dataType for f in registry.struct_of(name)}
        rows = rows.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns])
    return rows


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns strings, named by the header."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv_rows(rows: DataFrame, path: str, exclude: Iterable[str] = ()) -> None:
    """Nested values as JSON."""
    rows = rows.drop(*exclude)
    nested = (T.ArrayType, T.MapType, T.StructType)
    rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema]).write.option("header", True).option("escape", '"').csv(path)


def coerced(slot: Slot, c: Column) -> Column:
    """A string column as the slot's type; null where it cannot be."""
    def one(x: Column) -> Column:
        if slot.range in ("keyword", "symbol"):
            return keyword(x)
        return x.try_cast(slot.type.elementType if slot.many else slot.type) if not slot.is_ref else x

    return F.transform(F.filter(F.split(c, r"\s*,\s*"), lambda x: x != ""), one) if slot.many else one(c)


def coerce_slots(raw: DataFrame, registry: TypeRegistry, name: str) -> DataFrame:
    slots = {s.name: s for s in registry.slots_of(name)}
    return raw.select(*[coerced(slots[c], F.col(c)).alias(c) if c in slots else F.col(c) for c in raw.columns])


def resolve_refs(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """asked (ref) with id and reason: a ref is an id, or an ident with or without the colon; reasons are malformed, not-found and no-ident (found by id, unnamed)."""
    name = keyword(F.trim(F.col("ref")))
    good = name.rlike(r"^[^\s/]+(/\S+)?$")
    out = asked.withColumn("_n", F.when(good, name))
    by_id = ids.select(F.col("id").alias("_n"), F.col("id").alias("_by_id"), F.col("ident").alias("_ident"))
    by_ident = ids.where("ident is not null").select(F.col("ident").alias("_n"), F.col("id").alias("_by_ident"))
    out = out.join(by_id, "_n", "left").join(by_ident, "_n", "left")
    found = F.coalesce("_by_ident", "_by_id")
    reason = F.when(F.col("_n").isNull(), "malformed").when(found.isNull(), "not-found").when(F.col("_by_ident").isNull() & F.col("_ident").isNull(), "no-ident")
    return out.select("ref", found.alias("id"), reason.alias("reason"))


def split_valid(rows: DataFrame, registry: TypeRegistry, name: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with their errors) before a write."""
    checked = rows.withColumn("errors", row_errors(rows, registry, name))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def validated_append(rows: DataFrame, path: str, registry: TypeRegistry, name: str, abort: bool = False) -> DataFrame:
    """Appends the good rows and returns the rejects; abort: raises and writes nothing if there are any."""
    good, bad = split_valid(rows, registry, name)
    if abort and not bad.isEmpty():
        raise ValueError(f"invalid rows of {name}: nothing was written")
    good.write.mode("append").parquet(path)
    return bad


def upsert_slots(base: DataFrame, updates: DataFrame, additive: bool = False) -> DataFrame:
    """base with the set slots of updates (by id) put in; rows of new ids are added. Arrays are replaced, or with additive joined as sets."""
    both = base.alias("b").join(updates.alias("u"), F.col("b.id") == F.col("u.id"), "full")

    def one(c: str) -> Column:
        if c not in updates.columns:
            return F.col(f"b.{c}").alias(c)
        if additive and isinstance(base.schema[c].dataType, T.ArrayType):
            none = F.array().cast(base.schema[c].dataType)
            return F.array_union(F.coalesce(f"b.{c}", none), F.coalesce(f"u.{c}", none)).alias(c)
        return F.coalesce(f"u.{c}", f"b.{c}").alias(c)

    return both.select(*[one(c) for c in base.columns])


def retract(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id"), "id", "left_anti")
