"""Class-model tables: DataFrames (class, subclass_of array, slots array, abstract) and properties (slot, domain, range ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entigraph.operators.reach import FIRST, beyond, nearest
from entigraph.scratch import bucketed


def closure(pairs: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst, hop) for all dst reachable from src in one step or more, hop the fewest; from all sources, or from seeds (src) only.

    The first steps are taken one by one, each from what was new; longer chains are doubled (see reach). A cycle ends when it brings nothing new."""
    steps = pairs.select("src", "dst").where("src is not null and dst is not null").distinct()
    new = steps if seeds is None else steps.join(seeds.select("src").distinct(), "src", "left_semi")
    new = bucketed(new.withColumn("hop", F.lit(1)), "closure", "src", "dst")
    seen = [new]
    links = steps.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    for hop in range(2, FIRST + 1):
        if new.isEmpty():
            return reduce(DataFrame.union, seen)
        found = new.select("src", "dst").join(links, "dst").select("src", F.col("to").alias("dst")).distinct()
        for earlier in seen:  # each lies in buckets by the pair: none of it is moved again
            found = found.join(earlier.select("src", "dst"), ["src", "dst"], "left_anti")
        new = bucketed(found.withColumn("hop", F.lit(hop)), "closure", "src", "dst")
        seen.append(new)
    found = reduce(DataFrame.union, seen)
    if new.isEmpty():
        return found
    far = beyond(new.select(F.col("src").alias("seed"), F.col("dst").alias("node"), "hop"), steps.select(F.col("src").alias("node"), F.col("dst").alias("to")))
    return nearest(found.select(F.col("src").alias("seed"), F.col("dst").alias("node"), "hop").union(far)).select(F.col("seed").alias("src"), F.col("node").alias("dst"), "hop")


def parents(classes: DataFrame) -> DataFrame:
    return classes.select("class", F.explode("subclass_of").alias("parent"))


def direct_subclasses(classes: DataFrame) -> DataFrame:
    return parents(classes).select(F.col("parent").alias("class"), F.col("class").alias("subclass"))


def ancestors(classes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(class, ancestor), without the class itself; of all classes, or of some (class)."""
    up = closure(parents(classes).select(F.col("class").alias("src"), F.col("parent").alias("dst")), None if of is None else of.select(F.col("class").alias("src")))
    return up.select(F.col("src").alias("class"), F.col("dst").alias("ancestor")).where("class <> ancestor")


def subclasses(classes: DataFrame) -> DataFrame:
    return ancestors(classes).select(F.col("ancestor").alias("class"), F.col("class").alias("subclass"))


def family(classes: DataFrame) -> DataFrame:
    """(class, member): each class with itself and all below it."""
    return subclasses(classes).select("class", F.col("subclass").alias("member")).union(classes.select("class", F.col("class").alias("member")))


def is_subclass(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """asked (parent, child) with is_subclass. Only what is above the children asked for is looked at, not all pairs of the hierarchy."""
    up = ancestors(classes, asked.select(F.col("child").alias("class")).distinct())
    down = up.select(F.col("ancestor").alias("parent"), F.col("class").alias("child"), F.lit(True).alias("is_subclass"))
    return asked.join(down, ["parent", "child"], "left").withColumn("is_subclass", F.coalesce("is_subclass", F.lit(False)))


def is_instance(rows: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """rows (class, ...) of the class or one below it; only what is below it is looked at."""
    down = direct_subclasses(classes).select(F.col("class").alias("src"), F.col("subclass").alias("dst"))
    below = closure(down, down.sparkSession.createDataFrame([(name,)], "src string")).select(F.col("dst").alias("class"))
    own = classes.where(F.col("class") == name).select("class")
    return rows.join(below.union(own).distinct(), "class", "left_semi")


def direct_slots(classes: DataFrame) -> DataFrame:
    return classes.select("class", F.explode("slots").alias("slot"))


def effective_slots(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, slot, domain, range, cardinality, required), own and inherited."""
    own = direct_slots(classes)
    taken = ancestors(classes).join(own.select(F.col("class").alias("ancestor"), "slot"), "ancestor").select("class", "slot")
    return own.union(taken).distinct().join(properties, "slot").select("class", "slot", "domain", "range", "cardinality", "required")


def inherited_slots(classes: DataFrame, properties: DataFrame) -> DataFrame:
    return effective_slots(classes, properties).select("class", "slot").join(direct_slots(classes), ["class", "slot"], "left_anti")


def required_slots(classes: DataFrame, properties: DataFrame) -> DataFrame:
    return effective_slots(classes, properties).where("required").select("class", "slot")


def property_info(properties: DataFrame) -> DataFrame:
    return properties.select("slot", "domain", "range", "cardinality", (F.col("cardinality") == "many").alias("is_many"))


def properties_for_class(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, slot): properties whose domain is the class or one above it."""
    reach = family(classes).select(F.col("class").alias("domain"), F.col("member").alias("class"))
    return properties.join(reach, "domain").select("class", "slot")


def class_summary(classes: DataFrame, properties: DataFrame, instances: DataFrame) -> DataFrame:
    """A row a class: counts of slots (effective, direct, inherited), parents, direct subclasses, and direct instances (instances: class, n)."""
    count = lambda df, name: df.groupBy("class").agg(F.count("*").alias(name))
    out = classes.select("class", "abstract")
    for df, name in ((effective_slots(classes, properties), "n_slots"), (direct_slots(classes), "n_direct"), (inherited_slots(classes, properties), "n_inherited"), (parents(classes), "n_parents"), (direct_subclasses(classes), "n_subclasses")):
        out = out.join(count(df, name), "class", "left")
    out = out.join(instances.select("class", F.col("n").alias("n_instances")), "class", "left")
    return out.fillna(0)


def schema_overview(classes: DataFrame, properties: DataFrame) -> DataFrame:
    names = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    return classes.agg(F.count("*").alias("n_classes"), names("class").alias("classes")).crossJoin(properties.agg(F.count("*").alias("n_properties"), names("slot").alias("properties")))


def describe(rows: DataFrame) -> DataFrame:
    """(id, attribute, value): all facts of the rows, values as strings; arrays one fact an element."""
    def facts(f):
        if f.dataType.typeName() == "array":
            return F.transform(F.array_distinct(f.name), lambda v: F.struct(F.lit(f.name).alias("attribute"), v.cast("string").alias("value")))
        return F.array(F.struct(F.lit(f.name).alias("attribute"), F.col(f.name).cast("string").alias("value")))

    every = F.concat(*[facts(f) for f in rows.schema if f.name != "id"])
    return rows.select("id", F.explode(every).alias("f")).select("id", "f.attribute", "f.value").where("value is not null")


def class_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (id, class) with their class's metadata."""
    return rows.join(classes.select("class", "abstract", F.array_join("subclass_of", ",").alias("parents")), "class", "left")
