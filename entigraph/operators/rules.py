"""Rules that tables name: guards of transitions, conditions of triggered jobs, validators."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Rule = Callable[[], Column]
#: Distinct names in a table of rules' users, at most.
MAX_NAMES = 1_000


def names_in(table: DataFrame, column: str) -> list[str]:
    """The distinct names in a column: a small table's, whose number is checked."""
    rows = table.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names in {column}")
    return sorted(r[0] for r in rows)


def holds(rows: DataFrame, name: Column, names: list[str], rules: Mapping[str, Rule]) -> Column:
    """Whether the rule that `name` names holds for a row of rows: true where it names none; false where the rule is unknown, null, or asks for columns that rows lacks.

    Only the rules in names are looked at, so one that another table's columns need does no harm here."""
    out = F.when(name.isNull(), True)
    for n in names:
        if n in rules and (rule := resolved(rows, rules[n])) is not None:
            out = out.when(name == n, F.coalesce(rule, F.lit(False)))
    return out.otherwise(False)


def resolved(rows: DataFrame, rule: Rule) -> Column | None:
    """The rule's Column, or None if rows has not got what it needs."""
    try:
        c = rule()
        rows.select(c)
    except AnalysisException:
        return None
    return c


def per_row(f: Callable[[dict], object], columns: list[str], returns: str = "boolean", failed: object = None) -> Column:
    """A rule in Python over some columns of a row, given as a dict, in Arrow batches: for what column expressions can't say. Values are as in the row: nulls are None, whole
    numbers are exact. A row for which it raises gives `failed`, which may be a function of the exception; expressions have try_ functions for that."""
    kind = to_arrow_type(T.DataType.fromDDL(returns))

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            try:
                out.append(f(r))
            except Exception as e:  # a rule that fails for a row is that row's result
                out.append(failed(e) if callable(failed) else failed)
        return pa.array(out, kind)

    return F.arrow_udf(run, returns)(F.struct(*columns))
