"""Bulk validation against the class model: one row for each error."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.functions.text import UUID
from entigraph.model import TypeRegistry
from entigraph.operators.rules import Rule, resolved

ERROR = "struct<slot:string,error:string>"
#: Rules by class: a Column that is null where a row is valid, and else what is wrong. Calls may bring their own. A rule that can fail is given as per_row(..., failed=failure), or
#: made of try_ functions; one that asks for columns that are not there is an error of every row.
VALIDATORS: dict[str, Rule] = {}


def register_validator(name: str, rule: Rule) -> None:
    VALIDATORS[name] = rule


def failure(e: Exception) -> str:
    """What a rule that fails says of the row."""
    return f"validator-error: {type(e).__name__}"


def _error(slot: str, error: str) -> Column:
    return F.struct(F.lit(slot).alias("slot"), F.lit(error).alias("error"))


def _empty(df: DataFrame, slot: str) -> Column:
    c = F.col(slot)
    return c.isNull() | (F.size(c) == 0) if df.schema[slot].dataType.typeName() == "array" else c.isNull()


def _bad_literal(df: DataFrame, slot: str, range_: str) -> Column | None:
    """For raw strings: whether the value cannot be one of the range. Typed columns cannot go wrong."""
    if df.schema[slot].dataType.typeName() != "string":
        return None
    cast = {"long": "bigint", "double": "double", "float": "float", "boolean": "boolean", "instant": "timestamp", "bigint": "decimal(38,0)", "bigdec": "decimal(38,18)"}.get(range_)
    if cast:
        return F.col(slot).isNotNull() & F.col(slot).try_cast(cast).isNull()
    return F.col(slot).isNotNull() & ~F.col(slot).rlike(UUID) if range_ == "uuid" else None


def row_errors(df: DataFrame, registry: TypeRegistry, name: str, validators: Mapping[str, Rule] | None = None) -> Column:
    """Array of errors of a row: required, type, cardinality, abstract class, and the class's own rule among the validators."""
    tests: list[tuple[Column, Column]] = []
    if registry.classes[name].abstract:
        tests.append((F.lit(True), _error("class", "abstract-class")))
    for s in registry.slots_of(name):
        if s.name not in df.columns:
            if s.required:
                tests.append((F.lit(True), _error(s.name, "missing-required")))
            continue
        if s.required:
            tests.append((_empty(df, s.name), _error(s.name, "missing-required")))
        if (bad := _bad_literal(df, s.name, s.range)) is not None:
            tests.append((bad, _error(s.name, "invalid-type")))
        if not s.many and df.schema[s.name].dataType.typeName() == "array":
            tests.append((F.size(s.name) > 1, _error(s.name, "invalid-cardinality")))
    found = [F.when(test, error) for test, error in tests]
    if name in (validators or {}):
        message = resolved(df, validators[name])
        message = F.lit("validator-error: columns are missing") if message is None else message
        found.append(F.when(message.isNotNull(), F.struct(F.lit("").alias("slot"), message.alias("error"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{ERROR}>")


def validate_data(df: DataFrame, registry: TypeRegistry, name: str) -> DataFrame:
    """(id, slot, error) of rows before they are written; no custom rule."""
    return df.select("id", F.explode(row_errors(df, registry, name)).alias("e")).select("id", "e.slot", "e.error")


def dangling(df: DataFrame, slot: str, targets: DataFrame) -> DataFrame:
    """(id, slot, error) of references to none of the targets (id)."""
    refs = df.select("id", F.col(slot).alias("ref")).where("ref is not null")
    return refs.join(targets.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", F.lit(slot).alias("slot"), F.lit("invalid-reference").alias("error"))


def class_errors(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, slot, error) of rows (id, class) without a known class, or of an abstract one."""
    known = rows.join(classes.select("class", "abstract"), "class", "left")
    error = F.when(F.col("class").isNull(), "no-class").when(F.col("abstract").isNull(), "unknown-class").when(F.col("abstract"), "abstract-class")
    return known.select("id", F.lit("class").alias("slot"), error.alias("error")).where("error is not null")


def validate(df: DataFrame, registry: TypeRegistry, name: str, targets: dict[str, DataFrame] | None = None, validators: Mapping[str, Rule] | None = None) -> DataFrame:
    """(id, slot, error): all checks; targets gives the instances that references of a slot must be among."""
    out = df.select("id", F.explode(row_errors(df, registry, name, VALIDATORS if validators is None else validators)).alias("e")).select("id", "e.slot", "e.error")
    for slot, ids in (targets or {}).items():
        out = out.union(dangling(df, slot, ids))
    return out


def validate_all(df: DataFrame, registry: TypeRegistry, name: str, targets: dict[str, DataFrame] | None = None, validators: Mapping[str, Rule] | None = None) -> DataFrame:
    """(total, valid, invalid) of the rows, which are read once: each is flagged where it is, and only references are joined to their targets."""
    rows = df.withColumn("_bad", F.size(row_errors(df, registry, name, VALIDATORS if validators is None else validators)) > 0).select("_bad", *(targets or {}))
    for slot, ids in (targets or {}).items():
        rows = rows.join(ids.select(F.col("id").alias(slot)).distinct().withColumn("_found", F.lit(True)), slot, "left")
        rows = rows.withColumn("_bad", F.col("_bad") | (F.col(slot).isNotNull() & F.col("_found").isNull())).drop("_found")
    out = rows.agg(F.count("*").alias("total"), F.count_if("_bad").alias("invalid"))
    return out.select("total", (F.col("total") - F.col("invalid")).alias("valid"), "invalid")


RUN = "run_id string, class string, state string, total long, valid long, invalid long, started timestamp, ms long, message string"


def validation_run(spark: SparkSession, path: str, run_id: str, name: str, check: Callable[[], DataFrame], retries: int = 0) -> str:
    """Runs a check that gives (total, valid, invalid) and appends a row to the table of runs; the state is passed, failed or error."""
    began, state, counts, message = time.time(), "error", (None, None, None), None
    for _ in range(retries + 1):
        try:
            r = check().first()
            counts, state, message = (r.total, r.valid, r.invalid), "passed" if r.invalid == 0 else "failed", None
            break
        except Exception as e:  # the run records what went wrong
            message = str(e)[:500]
    row = (run_id, name, state, *counts, int((time.time() - began) * 1000), message)
    spark.createDataFrame([row], "run_id string, class string, state string, total long, valid long, invalid long, ms long, message string").withColumn("started", F.timestamp_seconds(F.lit(began))).select("run_id", "class", "state", "total", "valid", "invalid", "started", "ms", "message").write.mode("append").parquet(path)
    return state


def recent_validations(runs: DataFrame, name: str | None = None, state: str | None = None, limit: int = 10) -> DataFrame:
    for column, value in (("class", name), ("state", state)):
        runs = runs if value is None else runs.where(F.col(column) == value)
    return runs.orderBy(F.desc("started"), "run_id").limit(limit)
