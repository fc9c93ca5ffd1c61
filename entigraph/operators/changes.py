"""Differences of two versions of a table, patches made of them, and audit records.

A change is at a path: a column, fields of structs after dots, elements after brackets, as in `place.city`, `tags["new"]` and `lines[2].price` (indices begin at 0; names with one of `.[`
or a backtick stand in backticks). Values are texts: those of structs, maps and arrays JSON with all leaves as strings and maps in order of their keys, so that equal ones are the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entigraph.scratch import stored

NESTED = (T.StructType, T.MapType, T.ArrayType)
STEP = r'`(?:[^`]|``)*`|[^.\[`]+|\["(?:[^"\\]|\\.)*"\]|\[[0-9]+\]'


def _name(name: str) -> str:
    return f"`{name.replace('`', '``')}`" if re.search(r"[.\[`]", name) else name


def _key(key: Column) -> Column:
    """The step of a map's key: a JSON array of one string."""
    return F.to_json(F.array(key.cast("string")))


def _index(i: Column) -> Column:
    return F.concat(F.lit("["), i.cast("string"), F.lit("]"))


def _encoded(kind: T.DataType) -> T.DataType:
    """The type of a value with strings for leaves and map keys."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _encoded(f.dataType)) for f in kind])
    if isinstance(kind, T.MapType):
        if isinstance(kind.keyType, NESTED):
            raise TypeError("keys of maps are plain values")
        return T.MapType(T.StringType(), _encoded(kind.valueType))
    return T.ArrayType(_encoded(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()


def _encode(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_encode(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), _encode(e["value"], kind.valueType).alias("value")))
        # values may be maps, which have no order: sorted by the keys alone
        return F.map_from_entries(F.transform(F.array_sort(F.transform(pairs, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.get(F.filter(pairs, lambda e: e["key"] == k), F.lit(0))["value"].alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _encode(e, kind.elementType))
    return F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _decode(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_decode(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast(kind.keyType).alias("key"), _decode(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _decode(e, kind.elementType))
    return F.unbase64(c) if isinstance(kind, T.BinaryType) else c.cast(kind)


def as_text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(_encode(c, kind)) if isinstance(kind, NESTED) else _encode(c, kind)


def from_text(c: Column, kind: T.DataType) -> Column:
    return _decode(F.from_json(c, _encoded(kind)), kind) if isinstance(kind, NESTED) else _decode(c, kind)


def _change(op: str, path: Column, kind: T.DataType, old: Column | None = None, new: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else as_text(c, kind)
    return F.struct(F.lit(op).alias("op"), path.alias("path"), text(old).alias("old_value"), text(new).alias("new_value"))


_NONE = "array<struct<op:string,path:string,old_value:string,new_value:string>>"


def _changed(a: Column, b: Column, kind: T.DataType, path: Column) -> Column:
    """The changes from a to b, an array: structs by field, maps by key, arrays by place; a part that only one of them has is + or - there, all else *."""
    if not isinstance(kind, NESTED):
        return F.when(a.eqNullSafe(b), F.array().cast(_NONE)).otherwise(F.array(_change("*", path, kind, a, b)))
    return _let({"a": a, "b": b, "path": path}, lambda a, b, path: _changed_inside(a, b, kind, path))


def _changed_inside(a: Column, b: Column, kind: T.DataType, path: Column) -> Column:
    none = F.array().cast(_NONE)
    if isinstance(kind, T.StructType):
        parts = [_changed(a[f.name], b[f.name], f.dataType, F.concat(path, F.lit("." + _name(f.name)))) for f in kind]
        inner = F.concat(*parts) if parts else none
    elif isinstance(kind, T.MapType):
        v, at = kind.valueType, lambda k: F.concat(path, _key(k))
        both = lambda k: _changed(F.try_element_at(a, k), F.try_element_at(b, k), v, at(k))
        inner = F.concat(
            F.flatten(F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), both)),
            F.transform(F.array_except(F.map_keys(a), F.map_keys(b)), lambda k: _change("-", at(k), v, old=F.try_element_at(a, k))),
            F.transform(F.array_except(F.map_keys(b), F.map_keys(a)), lambda k: _change("+", at(k), v, new=F.try_element_at(b, k))),
        )
    else:
        e, at = kind.elementType, lambda i: F.concat(path, _index(i))

        def rest(long: Column, short: Column) -> Column:
            """The places that only the longer one has."""
            return F.when(F.size(long) > F.size(short), F.sequence(F.size(short), F.size(long) - 1)).otherwise(F.array().cast("array<int>"))

        shared = F.least(F.size(a), F.size(b))
        inner = F.concat(
            F.flatten(F.transform(F.when(shared > 0, F.sequence(F.lit(0), shared - 1)).otherwise(F.array().cast("array<int>")), lambda i: _changed(F.get(a, i), F.get(b, i), e, at(i)))),
            F.transform(rest(a, b), lambda i: _change("-", at(i), e, old=F.get(a, i))),
            F.transform(rest(b, a), lambda i: _change("+", at(i), e, new=F.get(b, i))),
        )
    return F.when(a.isNull() & b.isNull(), none).when(a.isNull() | b.isNull(), F.array(_change("*", path, kind, a, b))).otherwise(inner)


def _all_of(c: Column, kind: T.DataType, path: str, op: str) -> Column:
    """A whole row's values: one for each column or field; arrays and maps are one, and so are structs that are null."""
    one = F.array(_change(op, F.lit(path), kind, *((None, c) if op == "+" else (c, None))))
    if isinstance(kind, T.StructType) and len(kind):
        return F.when(c.isNull(), one).otherwise(F.concat(*[_all_of(c[f.name], f.dataType, f"{path}.{_name(f.name)}", op) for f in kind]))
    return one


def diff_snapshots(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, op, path, old_value, new_value): + and - for each column or field of rows that came or went; in rows of both * for changed values, + and - for elements of maps and
    arrays that came or went, at any depth. Null equals null, and maps are equal whatever the order of their entries. Columns are those of new; one that old lacks is null there."""
    fields = [f for f in new.schema if f.name != key]
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in old.columns}
    pack = lambda df: df.select(F.col(_name(key)).alias("k"), F.struct(*[F.col(_name(f.name)).cast(f.dataType).alias(f.name) for f in fields]).alias("v"))
    both = pack(old.withColumns(lacking)).alias("o").join(pack(new).alias("n"), F.col("o.k") == F.col("n.k"), "full")
    a, b = F.col("o.v"), F.col("n.v")
    each = []
    for f in fields:
        x, y, path = a[f.name], b[f.name], _name(f.name)
        each.append(F.when(F.col("o.k").isNull(), _all_of(y, f.dataType, path, "+")).when(F.col("n.k").isNull(), _all_of(x, f.dataType, path, "-")).otherwise(_changed(x, y, f.dataType, F.lit(path))))
    out = both.select(F.coalesce("n.k", "o.k").alias("id"), F.explode(F.concat(*each) if each else F.array().cast(_NONE)).alias("d"))
    return out.select("id", "d.op", "d.path", "d.old_value", "d.new_value")


def _steps(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(STEP), F.lit(0))


def _of_row(op: Column, steps: Column) -> Column:
    """Whether a + or - is its whole row's, not an element's."""
    return (op != "*") & ~F.exists(steps, lambda s: s.startswith("["))


def _let(values: dict[str, Column], f: Callable[..., Column]) -> Column:
    """f of some values by name, each of which stands in the expression once, however often f uses it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), lambda s: f(**{k: s[k] for k in values})), F.lit(0))


# A part's changes, below: an array of (op, steps from there on, old_value, new_value).


def _own(e: Column) -> Column:
    return F.size(e["steps"]) == 0


def _below(changes: Column, step: Column) -> Column:
    return F.transform(F.filter(changes, lambda e: F.get(e["steps"], F.lit(0)) == step), lambda e: F.struct(e["op"].alias("op"), F.slice(e["steps"], F.lit(2), F.size(e["steps"])).alias("steps"), e["old_value"].alias("old_value"), e["new_value"].alias("new_value")))


def _came(changes: Column) -> Column:
    return F.filter(changes, lambda e: (F.size(e["steps"]) == 1) & (e["op"] == "+"))


def _gone(changes: Column) -> Column:
    return F.exists(changes, lambda e: _own(e) & (e["op"] == "-"))


def _staying(named: Column, changes: Column) -> Column:
    """(of, mine) of elements, each with its step as `at`, that do not go, with their changes: the steps are made once, not for each change."""
    return F.filter(F.transform(named, lambda e: F.struct(e.alias("of"), _below(changes, e["at"]).alias("mine"))), lambda p: ~_gone(p["mine"]))


def _applied(a: Column, kind: T.DataType, changes: Column) -> Column:
    """A part with its changes made: all of it replaced, or field by field, key by key, place by place."""
    return _let({"a": a, "changes": changes}, lambda a, changes: _made(a, kind, changes))


def _made(a: Column, kind: T.DataType, changes: Column) -> Column:
    whole = F.get(F.filter(changes, _own), F.lit(0))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_applied(a[f.name], f.dataType, _below(changes, F.lit(_name(f.name)))).alias(f.name) for f in kind])
    elif isinstance(kind, T.MapType):
        had = F.coalesce(F.map_entries(a), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType, False), T.StructField("value", kind.valueType)]))))
        named = F.transform(had, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), _key(e["key"]).alias("at")))
        kept = F.transform(_staying(named, changes), lambda p: F.struct(p["of"]["key"].alias("key"), _applied(p["of"]["value"], kind.valueType, p["mine"]).alias("value")))
        fresh = F.filter(_came(changes), lambda e: ~F.exists(had, lambda h: _key(h["key"]) == F.get(e["steps"], F.lit(0))))
        key = lambda e: F.get(F.from_json(F.get(e["steps"], F.lit(0)), "array<string>"), F.lit(0)).cast(kind.keyType)
        inner = F.map_from_entries(F.concat(kept, F.transform(fresh, lambda e: F.struct(key(e).alias("key"), from_text(e["new_value"], kind.valueType).alias("value")))))
    elif isinstance(kind, T.ArrayType):
        had = F.coalesce(a, F.array().cast(kind))
        named = F.transform(had, lambda x, i: F.struct(x.alias("x"), _index(i).alias("at")))
        kept = F.transform(_staying(named, changes), lambda p: _applied(p["of"]["x"], kind.elementType, p["mine"]))
        place = lambda e: F.regexp_extract(F.get(e["steps"], F.lit(0)), "[0-9]+", 0).cast("int")
        fresh = F.filter(_came(changes), lambda e: place(e) >= F.size(had))
        fresh = F.array_sort(F.transform(fresh, lambda e: F.struct(place(e).alias("i"), e["new_value"].alias("v"))))
        inner = F.concat(kept, F.transform(fresh, lambda e: from_text(e["v"], kind.elementType)))
    else:
        return F.when(F.exists(changes, _own), from_text(whole["new_value"], kind)).otherwise(a)
    return F.when(F.size(changes) == 0, a).when(F.exists(changes, _own), from_text(whole["new_value"], kind)).otherwise(inner)


def _wrong(a: Column, kind: T.DataType, changes: Column) -> Column:
    """Whether a part is not as its changes have it: another old value, or an element that should be there or should not."""
    return _let({"a": a, "changes": changes}, lambda a, changes: F.when(F.size(changes) > 0, _differs(a, kind, changes)).otherwise(False))


def _differs(a: Column, kind: T.DataType, changes: Column) -> Column:
    text = as_text(a, kind)
    # a + of an element is looked at where its map or array is
    bad = F.exists(changes, lambda e: _own(e) & e["op"].isin("*", "-") & ~e["old_value"].eqNullSafe(text))
    if not isinstance(kind, NESTED):
        return bad | F.exists(changes, lambda e: ~_own(e))
    step = lambda e: F.get(e["steps"], F.lit(0))
    if isinstance(kind, T.StructType):
        for f in kind:
            bad = bad | _wrong(a[f.name], f.dataType, _below(changes, F.lit(_name(f.name))))
        return bad | F.exists(changes, lambda e: ~_own(e) & ~step(e).isin([_name(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        had, inside = F.coalesce(F.map_entries(a), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType, False), T.StructField("value", kind.valueType)])))), kind.valueType
        named = F.transform(had, lambda h: F.struct(_key(h["key"]).alias("at"), h["value"].alias("value")))
    else:
        had, inside = F.coalesce(a, F.array().cast(kind)), kind.elementType
        named = F.transform(had, lambda x, i: F.struct(_index(i).alias("at"), x.alias("value")))

    def elements(named: Column, changes: Column) -> Column:
        there = lambda e: F.exists(named, lambda h: h["at"] == step(e))
        missing = F.exists(changes, lambda e: ~_own(e) & F.when((e["op"] == "+") & (F.size(e["steps"]) == 1), there(e) | a.isNull()).otherwise(~there(e)))
        return missing | F.exists(named, lambda h: _wrong(h["value"], inside, F.filter(_below(changes, h["at"]), lambda e: ~(_own(e) & (e["op"] == "+")))))

    return bad | _let({"named": named, "changes": changes}, elements)


def patch(base: DataFrame, diff: DataFrame, key: str = "id", checked: bool = True) -> DataFrame:
    """base with a diff applied, as diff_snapshots gives it: patch(a, diff_snapshots(a, b)) is b. checked: raises if a row or value to change is not as the diff has it.

    Unchecked, elements that are not there are left out, and what stands above a changed field is made where it is null. A row's changes come together in one row."""
    changes = F.struct("op", _steps(F.col("path")).alias("steps"), "old_value", "new_value")
    wide = diff.select("id", changes.alias("c")).groupBy("id").agg(F.collect_list("c").alias("cs"))
    both = base.select(F.col(_name(key)).alias("k"), F.struct(*[c for c in map(_name, base.columns) if c != _name(key)]).alias("v")).join(wide, F.col("k") == F.col("id"), "full")
    cs = F.coalesce("cs", F.array().cast("array<struct<op:string,steps:array<string>,old_value:string,new_value:string>>"))
    both = both.withColumn("cs", cs).withColumn("row_op", F.get(F.filter("cs", lambda e: _of_row(e["op"], e["steps"])), F.lit(0))["op"])
    fields = [f for f in base.schema if f.name != key]
    of = lambda f: (F.col("v")[f.name], f.dataType, _below(F.col("cs"), F.lit(_name(f.name))))
    if checked:
        here = F.col("k").isNotNull()
        wrong = F.when(F.col("row_op") == "+", here).otherwise((F.size("cs") > 0) & ~here)
        for f in fields:
            wrong = wrong | F.when(F.coalesce("row_op", F.lit("")) != "+", _wrong(*of(f))).otherwise(False)
        wrong = wrong | F.exists("cs", lambda e: ~F.get(e["steps"], F.lit(0)).isin([_name(f.name) for f in fields]))
        both = stored(both, "patched")  # looked at twice, made once
        if n := both.where(wrong).count():
            raise ValueError(f"{n} rows are not as the diff has them")
    out = both.where(F.coalesce(F.col("row_op") != "-", F.lit(True)) & (F.col("k").isNotNull() | (F.col("row_op") == "+")))
    return out.select(F.coalesce("k", "id").alias(key), *[_applied(*of(f)).alias(f.name) for f in fields]).select(*map(_name, base.columns))


def audit_changes(diff: DataFrame, actor: str, reason: str, source: str, correlation_id: str, entity_type: str) -> DataFrame:
    """A typed change a row: creations and deletions once an entity with its data as JSON, updates once an attribute, elements of maps and arrays included."""
    whole_row = _of_row(F.col("op"), _steps(F.col("path")))
    what = F.when(F.col("op") == "+", "Create").when(F.col("op") == "-", "Delete").otherwise("Update")
    meta = [F.lit(v).alias(n) for n, v in (("entity_type", entity_type), ("actor", actor), ("reason", reason), ("source", source), ("correlation_id", correlation_id))]
    updates = diff.where(~whole_row).select(F.lit("Update").alias("class"), F.col("id").alias("entity"), F.col("path").alias("attribute"), "old_value", "new_value", F.lit(None).cast("string").alias("initial_data"), F.lit(None).cast("string").alias("final_data"))
    value = F.when(F.col("op") == "+", F.col("new_value")).otherwise(F.col("old_value"))
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("path", value.alias("v")))))
    whole = diff.where(whole_row).groupBy("id", "op").agg(F.to_json(F.map_from_entries(pairs)).alias("data"))
    none = F.lit(None).cast("string")
    whole = whole.select(what.alias("class"), F.col("id").alias("entity"), none.alias("attribute"), none.alias("old_value"), none.alias("new_value"), F.when(F.col("op") == "+", F.col("data")).alias("initial_data"), F.when(F.col("op") == "-", F.col("data")).alias("final_data"))
    return updates.unionByName(whole).select("*", *meta)


def audit_query(changes: DataFrame, **equal) -> DataFrame:
    """Changes by class, source, entity_type or correlation_id."""
    for c, v in equal.items():
        changes = changes.where(F.col(c) == v)
    return changes
