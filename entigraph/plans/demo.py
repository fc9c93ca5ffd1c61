"""The demonstration model over the test tables: ids are `Class/key`, so one edge table covers all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.graph import Sources, TypedGraph
from entigraph.model import ClassDef, Slot, TypeRegistry

CLASSES = [
    ClassDef("Resource", abstract=True),
    ClassDef("Place", ("Resource",), abstract=True),
    ClassDef("Region", ("Place",), (Slot("r_name", required=True),)),
    ClassDef("Nation", ("Place",), (Slot("n_name", required=True), Slot("in_region", "Region", required=True))),
    ClassDef("Party", ("Resource",), (Slot("in_nation", "Nation"), Slot("name"), Slot("acctbal", "double")), abstract=True),
    ClassDef("Customer", ("Party",), (Slot("mktsegment", required=True),)),
    ClassDef("Supplier", ("Party",)),
    ClassDef("Part", ("Resource",), (Slot("p_name", fulltext=True), Slot("p_brand", fulltext=True), Slot("p_type", fulltext=True), Slot("p_size", "long"), Slot("p_retailprice", "double")), weights={"p_name": 12.0, "p_type": 8.0, "p_brand": 1.0}),
    ClassDef("Transaction", ("Resource",), abstract=True),
    ClassDef("Order", ("Transaction",), (Slot("placed_by", "Customer", required=True), Slot("orderstatus"), Slot("totalprice", "double"), Slot("orderdate", "instant"), Slot("orderpriority"))),
    ClassDef("LineItem", ("Transaction",), (Slot("line_of", "Order"), Slot("of_part", "Part"), Slot("supplied_by", "Supplier"), Slot("quantity", "double"), Slot("shipdate", "instant"))),
    ClassDef("Event", ("Resource",), (Slot("ts", "instant"), Slot("user_id", "long"), Slot("event_type"), Slot("value", "double"), Slot("props"))),
    ClassDef("Text", ("Resource",), abstract=True),
    ClassDef("Document", ("Text",), (Slot("text", fulltext=True), Slot("lang"), Slot("source"))),
    ClassDef("Page", ("Text",), (Slot("url"), Slot("html"))),
    ClassDef("BenchmarkItem", ("Text",), (Slot("item_text"),)),
    ClassDef("Utterance", ("Text",), (Slot("role"), Slot("said"), Slot("next_turn", "Utterance"))),
]


def _id(name: str, *keys: str):
    return F.concat(F.lit(f"{name}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys])).alias("id")


def _ref(name: str, *keys: str):
    return F.when(F.col(keys[0]).isNotNull(), F.concat(F.lit(f"{name}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> TypeRegistry:
    return TypeRegistry(CLASSES)


def graph(spark: SparkSession, sf_dir: str) -> TypedGraph:
    t = lambda n: table(spark, sf_dir, n)

    def utterances() -> DataFrame:
        said = t("conversations").select("conv_id", "turn", F.col("role"), F.col("text").alias("said"))
        turns = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next")).distinct()
        out = said.join(turns, ["conv_id", "turn"], "left").select(_id("Utterance", "conv_id", "turn"), "role", "said", _ref("Utterance", "conv_id", "next").alias("next_turn"))
        # the reference is null where there is no next turn
        return out.withColumn("next_turn", F.when(F.col("next_turn").contains("-"), F.col("next_turn")))

    sources = {
        "Region": lambda: t("region").select(_id("Region", "r_regionkey"), F.col("r_name").alias("ident"), "r_name"),
        "Nation": lambda: t("nation").select(_id("Nation", "n_nationkey"), F.col("n_name").alias("ident"), "n_name", _ref("Region", "n_regionkey").alias("in_region")),
        "Customer": lambda: t("customer").select(_id("Customer", "c_custkey"), F.col("c_name").alias("name"), _ref("Nation", "c_nationkey").alias("in_nation"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment")),
        "Supplier": lambda: t("supplier").select(_id("Supplier", "s_suppkey"), F.col("s_name").alias("name"), _ref("Nation", "s_nationkey").alias("in_nation"), F.col("s_acctbal").alias("acctbal")),
        "Part": lambda: t("part").select(_id("Part", "p_partkey"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
        "Order": lambda: t("orders").select(_id("Order", "o_orderkey"), _ref("Customer", "o_custkey").alias("placed_by"), F.col("o_orderstatus").alias("orderstatus"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderdate").cast("timestamp").alias("orderdate"), F.col("o_orderpriority").alias("orderpriority")),
        "LineItem": lambda: t("lineitem").select(_id("LineItem", "l_orderkey", "l_linenumber"), _ref("Order", "l_orderkey").alias("line_of"), _ref("Part", "l_partkey").alias("of_part"), _ref("Supplier", "l_suppkey").alias("supplied_by"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").cast("timestamp").alias("shipdate")),
        "Event": lambda: t("events").select(_id("Event", "event_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props"),
        "Document": lambda: t("documents").select(_id("Document", "doc_id"), "text", "lang", "source"),
        "Page": lambda: t("pages").select(_id("Page", "page_id"), "url", "html"),
        "BenchmarkItem": lambda: t("benchmark").select(_id("BenchmarkItem", "item_id"), F.col("text").alias("item_text")),
        "Utterance": utterances,
    }
    return TypedGraph(spark, registry(), Sources(sources))


#: The same in SQL (DuckDB), as WITH clauses.
EDGES_SQL = """edges AS (
  SELECT 'Nation/' || n_nationkey AS src, 'in_region' AS predicate, 'Region/' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'Customer/' || c_custkey, 'in_nation', 'Nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'Supplier/' || s_suppkey, 'in_nation', 'Nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'Order/' || o_orderkey, 'placed_by', 'Customer/' || o_custkey FROM orders
  UNION ALL SELECT 'LineItem/' || l_orderkey || '-' || l_linenumber, 'line_of', 'Order/' || l_orderkey FROM lineitem
  UNION ALL SELECT 'LineItem/' || l_orderkey || '-' || l_linenumber, 'of_part', 'Part/' || l_partkey FROM lineitem
  UNION ALL SELECT 'LineItem/' || l_orderkey || '-' || l_linenumber, 'supplied_by', 'Supplier/' || l_suppkey FROM lineitem
  UNION ALL SELECT 'Utterance/' || a.conv_id || '-' || a.turn, 'next_turn', 'Utterance/' || b.conv_id || '-' || b.turn
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
)"""
CLASSES_SQL = "classes(class, abstract, parent) AS (VALUES " + ", ".join(f"('{c.name}', {str(c.abstract).lower()}, {repr(c.parents[0]) if c.parents else 'NULL'})" for c in CLASSES) + ")"
CLOSURE_SQL = f"{CLASSES_SQL}, up AS (SELECT class, parent AS ancestor FROM classes WHERE parent IS NOT NULL UNION SELECT up.class, c.parent FROM up JOIN classes c ON c.class = up.ancestor WHERE c.parent IS NOT NULL)"
_R = TypeRegistry(CLASSES)
SLOTS_SQL = "slots(class, slot) AS (VALUES " + ", ".join(f"('{c.name}', '{s.name}')" for c in CLASSES for s in c.slots) + ")"
PROPERTIES_SQL = "properties(slot, domain, range, cardinality, required) AS (VALUES " + ", ".join(f"('{s.name}', '{_R.domains[s.name]}', '{s.range}', '{'many' if s.many else 'one'}', {str(s.required).lower()})" for s in _R.slots.values()) + ")"
