"""Queries over the demonstration model, each with the same in SQL (DuckDB). Names begin with the operator's letter and number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.functions.text import normalize_body, slugify
from entigraph.operators import access, aggregate, changes, events, hierarchy, jobs, navigate, path, search, validate, workflow
from entigraph.operators.rules import per_row
from entigraph.plans import demo
from entigraph.plans.demo import CLASSES_SQL, CLOSURE_SQL, EDGES_SQL, PROPERTIES_SQL, SLOTS_SQL, table
from entigraph.scratch import new_path
from entigraph.sources import entities, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = True):
    """Registers f(g), or f(spark, sf_dir) where graph is False."""

    def keep(f):
        QUERIES[name] = (lambda spark, sf_dir: f(demo.graph(spark, sf_dir))) if graph else f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def classes(g):
    return g.registry.class_frame(g.spark), g.registry.property_frame(g.spark)


# a class model that lies in a table: parts by brand, type and size


def _taxonomy(spark, sf_dir):
    """(class, abstract, subclass_of, slots) and (slot, domain, range, cardinality, required) of all brands, types and sizes of parts."""
    p = table(spark, sf_dir, "part").where("p_brand is not null and p_type is not null and p_size is not null")
    kind, none = F.concat_ws("/", "p_brand", "p_type"), F.array().cast("array<string>")
    of = lambda c: F.concat(F.lit("of "), c)
    root = p.groupBy().agg(F.lit("Part").alias("class"), F.lit(True).alias("abstract"), none.alias("subclass_of"), F.array(F.lit("code")).alias("slots"))
    brands = p.select(F.col("p_brand").alias("class"), F.lit(True).alias("abstract"), F.array(F.lit("Part")).alias("subclass_of"), F.array(of(F.col("p_brand"))).alias("slots")).distinct()
    kinds = p.select(kind.alias("class"), F.lit(False).alias("abstract"), F.array("p_brand").alias("subclass_of"), F.array(of(kind), F.lit("code")).alias("slots")).distinct()
    sizes = p.select(F.concat_ws("/", kind, F.col("p_size").cast("string")).alias("class"), F.lit(False).alias("abstract"), F.array(kind).alias("subclass_of"), none.alias("slots")).distinct()
    c = root.union(brands).union(kinds).union(sizes)
    own = c.select("class", F.explode("slots").alias("slot")).groupBy("slot").agg(F.min_by("class", F.length("class")).alias("domain"))
    level = F.size(F.split("domain", "/"))
    properties = own.select("slot", "domain", F.when(level == 2, "long").otherwise("string").alias("range"), F.when(F.col("domain") == "Part", "many").otherwise("one").alias("cardinality"), ((level == 1) & (F.col("domain") != "Part")).alias("required"))
    return c, properties


_TAX = """p AS (SELECT * FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL), tax AS (
  SELECT 'Part' AS class, true AS abstract, NULL AS parent, ['code'] AS own FROM (SELECT count(*) FROM p) UNION ALL SELECT DISTINCT p_brand, true, 'Part', ['of ' || p_brand] FROM p
  UNION ALL SELECT DISTINCT p_brand || '/' || p_type, false, p_brand, ['of ' || p_brand || '/' || p_type, 'code'] FROM p UNION ALL SELECT DISTINCT p_brand || '/' || p_type || '/' || p_size, false, p_brand || '/' || p_type, [] FROM p)"""
_CLASSES = f"{_TAX}, classes AS (SELECT class, abstract, parent FROM tax)"
_SLOTS = "slots AS (SELECT class, unnest(own) AS slot FROM tax)"
_PROPERTIES = "properties AS (SELECT slot, domain, CASE WHEN contains(domain, '/') THEN 'long' ELSE 'string' END AS range, CASE domain WHEN 'Part' THEN 'many' ELSE 'one' END AS cardinality, domain <> 'Part' AND NOT contains(domain, '/') AS required FROM (SELECT slot, arg_min(class, length(class)) AS domain FROM (SELECT class, unnest(own) AS slot FROM tax) GROUP BY slot))"
_CLOSURE = f"{_CLASSES}, up AS (SELECT class, parent AS ancestor FROM classes WHERE parent IS NOT NULL UNION SELECT up.class, c.parent FROM up JOIN classes c ON c.class = up.ancestor WHERE c.parent IS NOT NULL)"


# A: scans, edges, JSON, CSV, coercion, writes


@query("a1_scan_class", "SELECT 'Order/' || o_orderkey AS id, 'Order' AS class, 'Customer/' || o_custkey AS placed_by, o_orderstatus AS orderstatus, o_totalprice AS totalprice FROM orders")
def _(g):
    return g.scan_class("Order", ["placed_by", "orderstatus", "totalprice"]).select("id", "class", "placed_by", "orderstatus", "totalprice")


@query("a2_scan_instances", "SELECT 'Customer/' || c_custkey AS id, 'Customer' AS class, c_name AS name, 'Nation/' || c_nationkey AS in_nation, c_mktsegment AS mktsegment FROM customer UNION ALL SELECT 'Supplier/' || s_suppkey, 'Supplier', s_name, 'Nation/' || s_nationkey, NULL FROM supplier")
def _(g):
    return g.scan_instances("Party", ["name", "in_nation", "mktsegment"]).select("id", "class", "name", "in_nation", "mktsegment")


@query("a3_scan_classes", "SELECT 'Customer' AS class, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT NULL, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)")
def _(g):
    return g.class_counts(["Customer", "Supplier", "Part"])


@query("a4_scan_named", "SELECT 'Region/' || r_regionkey AS id, r_name AS ident FROM region UNION ALL SELECT 'Nation/' || n_nationkey, n_name FROM nation")
def _(g):
    return g.scan_named("Resource").select("id", "ident")


@query("a5_load_model", f"WITH {_CLASSES}, {_SLOTS} SELECT c.class, c.abstract, c.parent, count(s.slot) AS n_slots FROM classes c LEFT JOIN slots s USING (class) GROUP BY ALL", graph=False)
def _(spark, sf_dir):
    return _taxonomy(spark, sf_dir)[0].select("class", "abstract", F.get("subclass_of", F.lit(0)).alias("parent"), F.size("slots").cast("long").alias("n_slots"))


@query("a6_build_edges", f"WITH {EDGES_SQL} SELECT src, predicate, dst FROM edges")
def _(g):
    return g.edges()


def _orders_json(g):
    from entigraph.sources.entities import entity_json

    rows = g.scan_class("Order", ["placed_by", "orderstatus", "orderpriority"]).select("id", "placed_by", "orderstatus", "orderpriority")
    return rows.select(entity_json(rows, g.registry, "Order", {"status": "orderstatus", "by": "placed_by"}).alias("value"))


@query("a11_read_entities_json", "SELECT 'Order/' || o_orderkey AS id, 'Customer/' || o_custkey AS placed_by, o_orderstatus AS orderstatus, o_orderpriority AS orderpriority FROM orders")
def _(g):
    from entigraph.scratch import new_path
    from entigraph.sources.entities import read_entities_json

    at = new_path(g.spark, "orders-json")
    _orders_json(g).write.text(at)
    return read_entities_json(g.spark, at, g.registry, "Order", {"status": "orderstatus", "by": "placed_by"}).select("id", "placed_by", "orderstatus", "orderpriority")


@query("a12_write_entities_json", """SELECT '{"_class":"Order","id":"Order/' || o_orderkey || '","by":"Customer/' || o_custkey || '","status":"' || o_orderstatus || '","orderpriority":"' || o_orderpriority || '"}' AS value FROM orders""")
def _(g):
    return _orders_json(g)


@query("a13_csv_rows", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def _(g):
    from entigraph.scratch import new_path
    from entigraph.sources.entities import read_csv_rows, write_csv_rows

    at = new_path(g.spark, "parts-csv")
    write_csv_rows(g.sources["Part"].select(F.expr("substring(id, 6)").alias("p_partkey"), "p_name", "p_brand", "p_type"), at, exclude=["p_type"])
    return read_csv_rows(g.spark, at)


@query("a15_coerce_slots", "SELECT 'Event/' || event_id AS id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events")
def _(g):
    from entigraph.sources.entities import coerce_slots

    raw = g.sources["Event"].select("id", F.col("ts").cast("string").alias("ts"), F.when(F.expr("cast(substring(id, 7) as long) % 7 = 0"), "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"), "event_type")
    return coerce_slots(raw, g.registry, "Event").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("a16_validated_append", "SELECT 'Customer/' || c_custkey AS id, 'missing-required' AS error FROM customer WHERE c_custkey % 5 = 0")
def _(g):
    from entigraph.scratch import new_path
    from entigraph.sources.entities import validated_append

    rows = g.scan_class("Customer").withColumn("mktsegment", F.expr("if(cast(substring(id, 10) as long) % 5 = 0, null, mktsegment)"))
    return validated_append(rows, new_path(g.spark, "appended"), g.registry, "Customer").select("id", F.explode("errors.error").alias("error"))


@query("a16_appended_rows", "SELECT 'Customer/' || c_custkey AS id, c_mktsegment AS mktsegment, n FROM customer, (SELECT unnest([1, 2]) AS n) WHERE c_custkey % 5 <> 0")
def _(g):
    """What lies at the path after two appends."""
    from entigraph.scratch import new_path
    from entigraph.sources.entities import validated_append

    at = new_path(g.spark, "appended")
    rows = g.scan_class("Customer").withColumn("mktsegment", F.expr("if(cast(substring(id, 10) as long) % 5 = 0, null, mktsegment)"))
    for n in (1, 2):
        validated_append(rows.withColumn("n", F.lit(n)), at, g.registry, "Customer")
    return g.spark.read.parquet(at).select("id", "mktsegment", "n")


_UPSERTED = "SELECT 'Customer/' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS mktsegment FROM customer UNION ALL SELECT 'Customer/-' || c_custkey, NULL, 'NEW' FROM customer WHERE c_custkey % 50 = 0"
_RETRACTED = "SELECT 'Part/' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"


def _updates(g):
    """Customers, and what is new of a third of them and of some more."""
    base = g.scan_class("Customer", ["name", "mktsegment"]).select("id", "name", "mktsegment")
    key = F.expr("cast(substring(id, 10) as long)")
    return base, base.where(key % 3 == 0).select("id", F.lit("UPDATED").alias("mktsegment")).union(base.where(key % 50 == 0).select(F.concat(F.lit("Customer/-"), key.cast("string")), F.lit("NEW")))


def _sold_much(g):
    return g.where("LineItem", ("quantity", ">", 45)).select(F.col("of_part").alias("id")).distinct()


@query("a17_upsert_slots", _UPSERTED)
def _(g):
    return entities.upsert_slots(*_updates(g))


@query("a17_upsert_store", _UPSERTED)
def _(g):
    base, updates = _updates(g)
    at = new_path(g.spark, "customers")
    store.write_store(base, at)
    store.upsert_store(g.spark, at, updates)
    return store.read_store(g.spark, at)


@query("a18_retract", _RETRACTED)
def _(g):
    return entities.retract(g.scan_class("Part", []), _sold_much(g)).select("id")


@query("a18_retract_store", _RETRACTED)
def _(g):
    at = new_path(g.spark, "parts")
    store.write_store(g.scan_class("Part", []).select("id"), at)
    store.retract_store(g.spark, at, _sold_much(g))
    return store.read_store(g.spark, at)


@query("a19_resolve_refs", """WITH ids AS (SELECT 'Nation/' || n_nationkey AS id, n_name AS ident FROM nation UNION ALL SELECT 'Customer/' || c_custkey, NULL FROM customer),
asked AS (SELECT 'Nation/' || n_nationkey AS ref, 'Nation/' || n_nationkey AS id, NULL AS reason FROM nation UNION ALL SELECT ':' || n_name, CASE WHEN n_name LIKE '% %' THEN NULL ELSE 'Nation/' || n_nationkey END, CASE WHEN n_name LIKE '% %' THEN 'malformed' END FROM nation
UNION ALL SELECT 'Customer/' || c_custkey, 'Customer/' || c_custkey, 'no-ident' FROM customer UNION ALL SELECT 'Part/' || p_partkey, NULL, 'not-found' FROM part UNION ALL SELECT 'a b c' || s_suppkey, NULL, 'malformed' FROM supplier) SELECT * FROM asked""")
def _(g):
    from entigraph.sources.entities import resolve_refs

    ids = g.scan_class("Nation", []).select("id", "ident").union(g.scan_class("Customer", []).select("id", "ident"))
    n = g.scan_class("Nation", [])
    asked = n.select(F.col("id").alias("ref")).union(n.select(F.concat(F.lit(":"), "ident"))).union(g.scan_class("Customer", []).select("id")).union(g.scan_class("Part", []).select("id"))
    return resolve_refs(asked.union(g.scan_class("Supplier", []).select(F.concat(F.lit("a b c"), F.expr("substring(id, 10)")))), ids)


# B: the class model


def _b(name, sql):
    def keep(f):
        query(name, sql, graph=False)(lambda spark, sf_dir: f(*_taxonomy(spark, sf_dir)))

    return keep


@_b("b1_classes", f"WITH {_CLASSES} SELECT class, abstract FROM classes")
def _(c, p):
    return c.select("class", "abstract")


@_b("b1_properties", f"WITH {_TAX}, {_PROPERTIES} SELECT slot, range FROM properties")
def _(c, p):
    return p.select("slot", "range")


@_b("b2_parents", f"WITH {_CLASSES} SELECT class, parent FROM classes WHERE parent IS NOT NULL")
def _(c, p):
    return hierarchy.parents(c)


@_b("b3_ancestors", f"WITH RECURSIVE {_CLOSURE} SELECT class, ancestor FROM up")
def _(c, p):
    return hierarchy.ancestors(c)


@_b("b4_direct_subclasses", f"WITH {_CLASSES} SELECT parent AS class, class AS subclass FROM classes WHERE parent IS NOT NULL")
def _(c, p):
    return hierarchy.direct_subclasses(c)


@_b("b5_subclasses", f"WITH RECURSIVE {_CLOSURE} SELECT ancestor AS class, class AS subclass FROM up")
def _(c, p):
    return hierarchy.subclasses(c)


@_b("b6_is_subclass", f"WITH RECURSIVE {_CLOSURE} SELECT a.class AS parent, b.class AS child, EXISTS (SELECT 1 FROM up WHERE up.class = b.class AND up.ancestor = a.class) AS is_subclass FROM classes a, classes b WHERE a.abstract")
def _(c, p):
    asked = c.where("abstract").select(F.col("class").alias("parent")).crossJoin(c.select(F.col("class").alias("child")))
    return hierarchy.is_subclass(asked, c)


@query("b7_is_instance", "SELECT 'Customer/' || c_custkey AS id FROM customer UNION ALL SELECT 'Supplier/' || s_suppkey FROM supplier")
def _(g):
    return hierarchy.is_instance(g.scan_instances("Resource", []).select("id", "class"), classes(g)[0], "Party").select("id")


@_b("b8_direct_slots", f"WITH {_TAX}, {_SLOTS} SELECT class, slot FROM slots")
def _(c, p):
    return hierarchy.direct_slots(c)


_EFFECTIVE = f"{_CLOSURE}, {_SLOTS}, {_PROPERTIES}, eff AS (SELECT class, slot FROM slots UNION SELECT up.class, s.slot FROM up JOIN slots s ON s.class = up.ancestor)"


@_b("b9_slots", f"WITH RECURSIVE {_EFFECTIVE} SELECT class, slot, domain, range, cardinality, required FROM eff JOIN properties USING (slot)")
def _(c, p):
    return hierarchy.effective_slots(c, p)


@_b("b10_inherited_slots", f"WITH RECURSIVE {_EFFECTIVE} SELECT class, slot FROM eff EXCEPT SELECT class, slot FROM slots")
def _(c, p):
    return hierarchy.inherited_slots(c, p)


@_b("b11_required_slots", f"WITH RECURSIVE {_EFFECTIVE} SELECT class, slot FROM eff JOIN properties USING (slot) WHERE required")
def _(c, p):
    return hierarchy.required_slots(c, p)


@_b("b12_property_info", f"WITH {_TAX}, {_PROPERTIES} SELECT slot, domain, range, cardinality, cardinality = 'many' AS is_many FROM properties")
def _(c, p):
    return hierarchy.property_info(p)


@_b("b13_properties_for_class", f"WITH RECURSIVE {_EFFECTIVE} SELECT class, slot FROM properties p JOIN (SELECT class, ancestor FROM up UNION SELECT class, class FROM classes) f ON f.ancestor = p.domain")
def _(c, p):
    return hierarchy.properties_for_class(c, p)


_DEMO = f"{CLOSURE_SQL}, {SLOTS_SQL}, {PROPERTIES_SQL}, eff AS (SELECT class, slot FROM slots UNION SELECT up.class, s.slot FROM up JOIN slots s ON s.class = up.ancestor)"


@query("b14_class_summary", f"""WITH RECURSIVE {_DEMO}, inst(class, n) AS (SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Order', count(*) FROM orders)
SELECT class, abstract, (SELECT count(*) FROM eff WHERE eff.class = c.class) AS n_slots, (SELECT count(*) FROM slots WHERE slots.class = c.class) AS n_direct,
(SELECT count(*) FROM eff WHERE eff.class = c.class) - (SELECT count(*) FROM slots WHERE slots.class = c.class) AS n_inherited, CAST(parent IS NOT NULL AS BIGINT) AS n_parents, (SELECT count(*) FROM classes d WHERE d.parent = c.class) AS n_subclasses,
coalesce((SELECT n FROM inst WHERE inst.class = c.class), 0) AS n_instances FROM classes c""")
def _(g):
    return hierarchy.class_summary(*classes(g), g.class_counts(["Customer", "Supplier", "Order"]).where("class is not null"))


@_b("b15_schema_overview", f"WITH {_CLASSES}, {_PROPERTIES} SELECT (SELECT count(*) FROM classes) AS n_classes, (SELECT string_agg(class, ',' ORDER BY class) FROM classes) AS classes, (SELECT count(*) FROM properties) AS n_properties, (SELECT string_agg(slot, ',' ORDER BY slot) FROM properties) AS properties")
def _(c, p):
    return hierarchy.schema_overview(c, p)


@query("b16_describe", "WITH n AS (SELECT 'Nation/' || n_nationkey AS id, n_name, 'Region/' || n_regionkey AS r FROM nation) SELECT id, 'ident' AS attribute, n_name AS value FROM n UNION ALL SELECT id, 'n_name', n_name FROM n UNION ALL SELECT id, 'in_region', r FROM n UNION ALL SELECT id, 'class', 'Nation' FROM n")
def _(g):
    return hierarchy.describe(g.scan_class("Nation"))


@query("b17_class_of", "SELECT 'Supplier/' || s_suppkey AS id, 'Supplier' AS class, false AS abstract, 'Party' AS parents FROM supplier")
def _(g):
    return hierarchy.class_of(g.scan_class("Supplier", []).select("id", "class"), classes(g)[0])


# C: predicates, joins, sets


@query("c1_where", "SELECT 'Order/' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(g):
    return g.where("Order", ("orderstatus", "=", "F"), ("orderpriority", "=", "1-URGENT"), slots=["orderstatus", "orderpriority"]).select("id")


@query("c2_where_shared", "SELECT 'Customer/' || c_custkey AS customer, 'Supplier/' || s_suppkey AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 9000")
def _(g):
    c = g.where("Customer", ("acctbal", ">", 9000.0), ("in_nation", "exists"), slots=["acctbal", "in_nation"]).select(F.col("id").alias("customer"), "in_nation")
    s = g.where("Supplier", ("acctbal", ">", 9000.0), slots=["acctbal", "in_nation"]).select(F.col("id").alias("supplier"), "in_nation")
    return c.join(s, "in_nation").select("customer", "supplier")


@query("c3_where_refs", "SELECT 'Customer/' || c_custkey AS id, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def _(g):
    c = g.scan_class("Customer", ["in_nation"]).select("id", "in_nation")
    r = g.where("Region", ("r_name", "=", "ASIA")).select(F.col("id").alias("in_region"), "r_name")
    n = g.scan_class("Nation", ["in_region"]).select(F.col("id").alias("in_nation"), "in_region").join(r, "in_region")
    return c.join(n, "in_nation").select("id", "r_name")


@query("c4_ranges", "SELECT 'Order/' || o_orderkey AS id, o_totalprice AS totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice >= 150000")
def _(g):
    since, until = (F.to_timestamp(F.lit(d)) for d in ("1995-01-01", "1996-01-01"))
    return g.where("Order", F.col("orderdate") >= since, F.col("orderdate") < until, ("totalprice", ">=", 150000.0), slots=["orderdate", "totalprice"]).select("id", "totalprice")


@query("c5_membership", "SELECT 'Event/' || event_id AS id FROM events WHERE event_type IN ('error', 'purchase')")
def _(g):
    return g.where("Event", ("event_type", "in", ["error", "purchase"]), slots=["event_type"]).select("id")


@query("c6_semi_join", "SELECT 'Customer/' || c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(g):
    big = g.where("Order", ("totalprice", ">", 200000.0), slots=["totalprice", "placed_by"]).select(F.col("placed_by").alias("id"))
    return g.scan_class("Customer", []).join(big, "id", "left_semi").select("id")


@query("c7_anti_join", "SELECT 'Customer/' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 250000)")
def _(g):
    big = g.where("Order", ("orderpriority", "=", "1-URGENT"), ("totalprice", ">", 250000.0), slots=["placed_by", "orderpriority", "totalprice"])
    return g.scan_class("Customer", []).join(big.select(F.col("placed_by").alias("id")), "id", "left_anti").select("id")


@query("c8_instance_of", f"WITH {EDGES_SQL} SELECT src, predicate, dst FROM edges WHERE dst LIKE 'Customer/%' OR dst LIKE 'Supplier/%'")
def _(g):
    return g.instance_of(g.edges(), "Party", "dst").select("src", "predicate", "dst")


@query("c9_union", "SELECT 'Part/' || p_partkey AS id FROM part WHERE p_size > 40 UNION SELECT 'Part/' || p_partkey FROM part WHERE p_retailprice > 1500")
def _(g):
    return g.where("Part", ("p_size", ">", 40)).select("id").unionByName(g.where("Part", ("p_retailprice", ">", 1500.0)).select("id")).distinct()


@query("c10_difference", "SELECT 'Part/' || p_partkey AS id FROM part WHERE p_size > 40 EXCEPT SELECT 'Part/' || p_partkey FROM part WHERE p_retailprice > 1500")
def _(g):
    return g.where("Part", ("p_size", ">", 40)).select("id").subtract(g.where("Part", ("p_retailprice", ">", 1500.0)).select("id"))


@query("c11_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(g):
    return g.scan_class("Part", ["p_brand", "p_type"]).select("p_brand", "p_type").distinct()


@query("c12_concatenation", "SELECT 'Order/' || o_orderkey AS id, o_orderstatus AS orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'Order/' || o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def _(g):
    return g.where("Order", ("orderstatus", "=", "O")).select("id", "orderstatus").union(g.where("Order", ("orderstatus", "!=", "P")).select("id", "orderstatus"))


@query("c13_projection", "SELECT 'Nation/' || n_nationkey AS id, n_name AS ident, 'Region/' || n_regionkey AS in_region FROM nation")
def _(g):
    from entigraph.graph import project

    return project(g.scan_class("Nation"), ["in_region"])


# D and E: aggregation, ranks, top-k


@query("d1_count_by", "SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem WHERE l_quantity > 40")
def _(g):
    return aggregate.count_by(g.where("LineItem", ("quantity", ">", 40.0), slots=["quantity"]))


@query("d2_group_by", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def _(g):
    return aggregate.group_by(g.scan_class("Order", ["orderpriority"]), "orderpriority")


_DEGREE = f"WITH {EDGES_SQL}, deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), back AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst), party AS (SELECT 'Customer/' || c_custkey AS id FROM customer UNION ALL SELECT 'Supplier/' || s_suppkey FROM supplier)"


@query("d3_degree", f"{_DEGREE} SELECT id, coalesce(n, 0) AS score FROM party LEFT JOIN deg USING (id)")
def _(g):
    return aggregate.degree(g.scan_instances("Party", []), g.edges(near="Party"))


@query("d4_backlink_density", f"{_DEGREE} SELECT id, coalesce(n, 0) AS score FROM party LEFT JOIN back USING (id)")
def _(g):
    return aggregate.backlink_density(g.scan_instances("Party", []), g.edges(["placed_by", "supplied_by"]))


@query("d5_rank_degree", f"{_DEGREE} SELECT id, coalesce(n, 0) AS score FROM party LEFT JOIN deg USING (id) ORDER BY score DESC, id LIMIT 20")
def _(g):
    return aggregate.rank_by(g.scan_instances("Party", []), "degree", g.edges(near="Party"))


@query("d6_rank_backlinks", f"{_DEGREE} SELECT id, coalesce(n, 0) AS score FROM party LEFT JOIN back USING (id) ORDER BY score DESC, id LIMIT 20")
def _(g):
    return aggregate.rank_by(g.scan_instances("Party", []), "backlink_density", g.edges(["placed_by", "supplied_by", "in_nation"]))


@query("d7_rank_recency", "SELECT 'Order/' || o_orderkey AS id, o_orderdate AS value FROM orders ORDER BY o_orderdate DESC, id LIMIT 20")
def _(g):
    return aggregate.rank_by(g.scan_class("Order", ["orderdate"]), "recency", slot="orderdate").withColumn("value", F.col("value").cast("timestamp_ntz"))


@query("d8_rank_freshness", "SELECT 'Order/' || o_orderkey AS id, o_orderdate AS value FROM orders ORDER BY o_orderdate, id LIMIT 20")
def _(g):
    return aggregate.rank_by(g.scan_class("Order", ["orderdate"]), "freshness", slot="orderdate").withColumn("value", F.col("value").cast("timestamp_ntz"))


@query("d9_rank_within", f"{_DEGREE}, s AS (SELECT 'Nation/' || c_nationkey AS in_nation, 'Customer/' || c_custkey AS id, coalesce(n, 0) AS score FROM customer LEFT JOIN back ON back.id = 'Customer/' || c_custkey) SELECT * FROM (SELECT in_nation, id, score, row_number() OVER (PARTITION BY in_nation ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3")
def _(g):
    c = g.scan_class("Customer", ["in_nation"])
    return aggregate.rank_within(aggregate.backlink_density(c, g.edges(["placed_by"])).join(c.select("id", "in_nation"), "id"), "in_nation", 3)


@query("d10_facets", "SELECT 'orderstatus' AS slot, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 2 UNION ALL SELECT 'orderpriority', o_orderpriority, count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY 2")
def _(g):
    return aggregate.facets(g.where("Order", ("totalprice", ">", 100000.0)), ["orderstatus", "orderpriority"])


@query("e1_top_k", "SELECT 'Part/' || p_partkey AS id, p_retailprice FROM part ORDER BY p_retailprice DESC, id LIMIT 25")
def _(g):
    return aggregate.top_k(g.scan_class("Part", ["p_retailprice"]).select("id", "p_retailprice"), 25, F.desc("p_retailprice"))


@query("e1_top_k_counts", "SELECT count(*) AS total, least(count(*), 25) AS returned FROM part")
def _(g):
    return aggregate.top_k_counts(g.scan_class("Part", []), 25)


@query("e2_canonical_sort", "SELECT 'Nation' AS class, n_name AS ident FROM nation UNION ALL SELECT 'Region', r_name FROM region")
def _(g):
    return aggregate.by_class_and_name(g.scan_instances("Place", [])).select("class", "ident")


# F: navigation

_SEEDS_C = "seeds AS (SELECT 'Customer/' || c_custkey AS seed FROM customer WHERE c_custkey % 50 = 0)"


def _seeds(g, name="Customer", every=50):
    return g.scan_class(name, []).where(F.expr(f"try_cast(substring_index(id, '/', -1) as long) % {every} = 0")).select("id")


@query("f1_outbound_edges", f"WITH {EDGES_SQL}, {_SEEDS_C} SELECT seed, predicate, dst AS node FROM seeds JOIN edges ON src = seed")
def _(g):
    return navigate.outbound_edges(_seeds(g), g.edges_within("Customer", 1))


@query("f2_inbound_edges", f"WITH {EDGES_SQL}, {_SEEDS_C} SELECT seed, predicate, node FROM (SELECT seed, predicate, src AS node, row_number() OVER (PARTITION BY seed ORDER BY predicate, src) AS n FROM seeds JOIN edges ON dst = seed WHERE predicate = 'placed_by') WHERE n <= 5")
def _(g):
    return navigate.inbound_edges(_seeds(g), g.edges(["placed_by"]), ["placed_by"], g.scan_instances("Transaction", []), 5)


@query("f3_library_card", f"WITH {EDGES_SQL}, {_SEEDS_C} SELECT seed, 'home' AS axis, predicate, dst AS node FROM seeds JOIN edges ON src = seed WHERE predicate = 'in_nation' UNION ALL SELECT seed, 'orders', predicate, src FROM seeds JOIN edges ON dst = seed WHERE predicate = 'placed_by'")
def _(g):
    return navigate.library_card(_seeds(g), g.edges(), {"home": {"predicates": ["in_nation"]}, "orders": {"direction": "inbound", "predicates": ["placed_by"]}})


@query("f4_siblings", "WITH p AS (SELECT 'Page/' || page_id AS id, page_id, regexp_extract(url, '^(.*/)?', 0) AS dir FROM pages WHERE url IS NOT NULL) SELECT a.id AS seed, b.id AS node FROM p a JOIN p b ON a.dir = b.dir AND a.id <> b.id WHERE a.page_id % 50 = 0")
def _(g):
    return navigate.siblings(_seeds(g, "Page"), g.scan_class("Page", ["url"]), "url")


@query("f4_first_siblings", "WITH p AS (SELECT 'Page/' || page_id AS id, page_id, regexp_extract(url, '^(.*/)?', 0) AS dir FROM pages WHERE url IS NOT NULL) SELECT seed, node FROM (SELECT a.id AS seed, b.id AS node, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS n FROM p a JOIN p b ON a.dir = b.dir AND a.id <> b.id WHERE a.page_id % 50 = 0) WHERE n <= 3")
def _(g):
    return navigate.siblings(_seeds(g, "Page"), g.scan_class("Page", ["url"]), "url", 3)


@query("f4_sibling_groups", "WITH p AS (SELECT 'Page/' || page_id AS id, page_id % 50 = 0 AS is_seed, regexp_extract(url, '^(.*/)?', 0) AS dir FROM pages WHERE url IS NOT NULL) SELECT dir, id, is_seed FROM p WHERE dir IN (SELECT dir FROM p WHERE is_seed)")
def _(g):
    return navigate.sibling_groups(_seeds(g, "Page"), g.scan_class("Page", ["url"]), "url")


_WALK = f"{EDGES_SQL}, {_SEEDS_C}, h1 AS (SELECT DISTINCT seed, dst AS node FROM seeds JOIN edges ON src = seed), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN edges ON src = node)"


@query("f5_graph_walk", f"WITH {_WALK} SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2")
def _(g):
    return navigate.graph_walk(_seeds(g), g.edges_within("Customer", 2), 2)


@query("f6_graph_walk_paths", f"WITH {_WALK} SELECT seed, node, 1 AS hop, 'in_nation>' || node AS way FROM h1 UNION ALL SELECT h2.seed, h2.node, 2, 'in_nation>' || h1.node || '>in_region>' || h2.node FROM h2 JOIN h1 USING (seed)")
def _(g):
    w = navigate.graph_walk(_seeds(g), g.edges_within("Customer", 3), 3, paths=True)
    return w.select("seed", "node", "hop", F.array_join(F.transform("path", lambda s: F.concat(s["predicate"], F.lit(">"), s["node"])), ">").alias("way"))


@query("f7_realize_bundle", "SELECT DISTINCT 'Utterance/' || conv_id || '-' || turn AS id FROM conversations")
def _(g):
    u = g.scan_class("Utterance", ["next_turn"])
    seeds = u.where("id like '%-0'").select("id")
    return navigate.realize_bundle(seeds, u, g.edges(["next_turn"]), ["next_turn"]).select("id").distinct()


@query("f8_section_chain", "SELECT 'Utterance/' || conv_id || '-0' AS head, 'Utterance/' || conv_id || '-' || turn AS id, CAST(turn AS INTEGER) AS ord FROM conversations")
def _(g):
    return navigate.section_chain(g.scan_class("Utterance", ["next_turn"]), "next_turn")


# G: path algebra

_P, _SEEDS_O = path, "seeds AS (SELECT 'Order/' || o_orderkey AS seed FROM orders WHERE o_orderkey % 50 = 0)"
_CHAIN = "seeds AS (SELECT 'Utterance/' || conv_id || '-' || turn AS seed FROM conversations)"


def _utterances(g):
    return g.scan_class("Utterance", []).select("id")


def _g(name, body, via, seeds=None, direction=None):
    """direction: of a path of one step with any predicate, which asks only for the edges that leave orders or lead to them."""
    of = seeds or (lambda g: _seeds(g, "Order"))
    query(name, f"WITH RECURSIVE {EDGES_SQL}, {_CHAIN if seeds else _SEEDS_O}{body}")(lambda g: path.follow(g, of(g), via, edges=direction and g.edges_within("Order", 1, direction)))


_PLACED = "(SELECT seed, dst AS node FROM seeds JOIN edges ON src = seed WHERE predicate = 'placed_by')"
_g("g1_step", f" SELECT DISTINCT * FROM {_PLACED}", path.P("placed_by"))
_g("g2_seq", f" SELECT DISTINCT p.seed, e.dst AS node FROM {_PLACED} p JOIN edges e ON e.src = p.node AND e.predicate = 'in_nation'", path.Seq(path.P("placed_by"), path.P("in_nation")))
_g("g3_or", " SELECT DISTINCT seed, dst AS node FROM seeds JOIN edges ON src = seed WHERE predicate = 'placed_by' UNION SELECT seed, src FROM seeds JOIN edges ON dst = seed WHERE predicate = 'line_of'", path.Or(path.P("placed_by"), path.Inv(path.P("line_of"))))
_REACH = ", reach AS (SELECT seed, dst AS node FROM seeds JOIN edges ON src = seed AND predicate = 'next_turn' UNION SELECT seed, dst FROM reach JOIN edges ON src = node AND predicate = 'next_turn')"
_g("g4_plus", f"{_REACH} SELECT seed, node FROM reach", path.Plus(path.P("next_turn")), _utterances)
_g("g5_star", f"{_REACH} SELECT seed, node FROM reach UNION SELECT seed, seed FROM seeds", path.Star(path.P("next_turn")), _utterances)
_g("g6_inv", " SELECT DISTINCT s.seed, i.src AS node FROM seeds s JOIN edges l ON l.src = s.seed AND l.predicate = 'placed_by' JOIN edges i ON i.dst = l.dst AND i.predicate = 'placed_by'", path.Seq(path.P("placed_by"), path.Inv(path.P("placed_by"))))
_g("g7_self", " SELECT seed, seed AS node FROM seeds", path.Self())
_g("g8_any", " SELECT DISTINCT seed, dst AS node FROM seeds JOIN edges ON src = seed", path.Any(), direction="forward")
_g("g9_restrict", f" SELECT DISTINCT seed, node FROM {_PLACED} JOIN customer ON node = 'Customer/' || c_custkey WHERE c_mktsegment = 'BUILDING'", path.Seq(path.P("placed_by"), path.Restrict("mktsegment", "BUILDING")))
_g("g10_not", " SELECT DISTINCT seed, src AS node FROM seeds JOIN edges ON dst = seed WHERE predicate NOT IN ('placed_by')", path.Inv(path.Not("placed_by")), direction="inverse")
_g("g11_opt", f" SELECT seed, node FROM {_PLACED} UNION SELECT seed, seed FROM seeds", path.Opt(path.P("placed_by")))
_g("g12_rep", ", r1 AS (SELECT seed, dst AS node FROM seeds JOIN edges ON src = seed AND predicate = 'next_turn'), r2 AS (SELECT seed, dst AS node FROM r1 JOIN edges ON src = node AND predicate = 'next_turn'), r3 AS (SELECT seed, dst AS node FROM r2 JOIN edges ON src = node AND predicate = 'next_turn') SELECT * FROM r2 UNION SELECT * FROM r3", path.Rep(path.P("next_turn"), 2, 3), _utterances)
_g("g13_filter", f" SELECT DISTINCT p.seed, e.dst AS node FROM {_PLACED} p JOIN edges e ON e.src = p.node AND e.predicate = 'in_nation' JOIN nation ON e.dst = 'Nation/' || n_nationkey WHERE contains(n_name, 'A')", path.Filter(path.Seq(path.P("placed_by"), path.P("in_nation")), "A"))
_g("g14_test", f" SELECT DISTINCT seed, node FROM {_PLACED} WHERE CAST(substr(node, 10) AS BIGINT) % 2 = 0", path.Test(path.P("placed_by"), "even?"))


@query("g15_path_via", f"WITH {EDGES_SQL}, {_SEEDS_O}, r AS (SELECT DISTINCT seed, dst AS node FROM seeds JOIN edges ON src = seed WHERE predicate = 'placed_by') SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM seeds WHERE seed LIKE '%0') AS missing")
def _(g):
    seeds = _seeds(g, "Order")
    lost = path.missing_seeds(seeds.union(seeds.where("id like '%0'").select(F.concat("id", F.lit("x")))), g.scan_class("Order", []))
    return path.follow(g, seeds, path.P("placed_by")).agg(F.count("*").alias("total")).crossJoin(lost.agg(F.count("*").alias("missing")))


def _walked(g):
    return path.follow(g, _utterances(g), path.Plus(path.P("next_turn")), paths=True)


@query("g16_paths", f"WITH RECURSIVE {EDGES_SQL}, {_CHAIN}, reach AS (SELECT seed, dst AS node, seed || '>' || dst AS way FROM seeds JOIN edges ON src = seed AND predicate = 'next_turn' UNION SELECT seed, dst, way || '>' || dst FROM reach JOIN edges ON src = node AND predicate = 'next_turn') SELECT seed, node, way FROM reach")
def _(g):
    return _walked(g).select("seed", "node", F.array_join("path.nodes", ">").alias("way"))


@query("g17_path_facts", f"WITH RECURSIVE {EDGES_SQL}, {_CHAIN}, reach AS (SELECT seed, dst AS node, 1 AS length FROM seeds JOIN edges ON src = seed AND predicate = 'next_turn' UNION SELECT seed, dst, length + 1 FROM reach JOIN edges ON src = node AND predicate = 'next_turn') SELECT length, seed AS start, node AS \"end\", repeat('next_turn ', length) AS predicates, true AS valid FROM reach")
def _(g):
    return path.path_facts(_walked(g)).select("length", "start", "end", F.concat(F.array_join("predicates", " "), F.lit(" ")).alias("predicates"), "valid")


@query("g18_concat_reverse", f"WITH {EDGES_SQL}, {_SEEDS_O} SELECT e.dst || '<' || p.dst || '<' || seed AS way, 'inverse,inverse' AS directions FROM seeds JOIN edges p ON p.src = seed AND p.predicate = 'placed_by' JOIN edges e ON e.src = p.dst AND e.predicate = 'in_nation'")
def _(g):
    first = path.follow(g, _seeds(g, "Order"), path.P("placed_by"), paths=True)
    second = path.follow(g, first.select(F.col("node").alias("id")), path.P("in_nation"), paths=True)
    back = path.concat_paths(first, second).select(path.reverse_path().alias("path"))
    return back.select(F.array_join("path.nodes", "<").alias("way"), F.array_join("path.edges.direction", ",").alias("directions"))


@query("g19_prefixes", f"WITH RECURSIVE {EDGES_SQL}, {_CHAIN}, reach AS (SELECT seed, dst AS node, 1 AS n FROM seeds JOIN edges ON src = seed AND predicate = 'next_turn' UNION SELECT seed, dst, n + 1 FROM reach JOIN edges ON src = node AND predicate = 'next_turn') SELECT a.seed, a.node AS short_end, b.node AS long_end FROM reach a JOIN reach b ON a.seed = b.seed AND a.n <= b.n")
def _(g):
    w = _walked(g)
    out = path.prefixes(w, w)
    return out.select(F.expr("short.nodes[0]").alias("seed"), F.element_at("short.nodes", -1).alias("short_end"), F.element_at("long.nodes", -1).alias("long_end"))


_REACH = f"WITH RECURSIVE {EDGES_SQL}, {_CHAIN}, reach AS (SELECT seed, dst AS node, 1 AS n FROM seeds JOIN edges ON src = seed AND predicate = 'next_turn' UNION SELECT seed, dst, n + 1 FROM reach JOIN edges ON src = node AND predicate = 'next_turn')"


def _ends(pairs):
    return pairs.select(*(F.element_at(f"{k}.nodes", i).alias(f"{k}_{name}") for k in ("short", "long") for i, name in ((1, "start"), (-1, "end"))))


@query("g19_all_prefixes", f"{_REACH} SELECT a.seed AS short_start, a.node AS short_end, b.seed AS long_start, b.node AS long_end FROM reach a JOIN reach b ON a.seed = b.seed AND a.n <= b.n")
def _(g):
    w = _walked(g)
    return _ends(path.prefixes(w, w))


@query("g19_suffixes", f"{_REACH} SELECT a.seed AS short_start, a.node AS short_end, b.seed AS long_start, b.node AS long_end FROM reach a JOIN reach b ON a.node = b.node AND a.n <= b.n")
def _(g):
    w = _walked(g)
    return _ends(path.suffixes(w, w))


@query("g19_subpaths", f"{_REACH}, places AS (SELECT seed, seed AS node, 0 AS n FROM seeds UNION ALL SELECT * FROM reach) SELECT DISTINCT a.seed AS short_start, a.node AS short_end, b.seed AS long_start, b.node AS long_end FROM reach b JOIN places p ON p.seed = b.seed JOIN reach a ON a.seed = p.node AND p.n + a.n <= b.n")
def _(g):
    w = _walked(g)
    return _ends(path.subpaths(w, w))



# H: search

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
_PART = ["p_name", "p_type", "p_brand"]
#: Stems of the words in parts' names, types and brands that are not the words themselves.
_STEM = "CASE {0} WHEN 'large' THEN 'larg' WHEN 'economy' THEN 'economi' ELSE {0} END"
_HSQL = "f AS (" + " UNION ALL ".join(f"SELECT 'Part/' || p_partkey AS id, '{f}' AS field, {_TOK.format(f)} AS t, {w} AS weight FROM part" for f, w in (("p_name", 12.0), ("p_type", 8.0), ("p_brand", 1.0))) + "), lens AS (SELECT id, field, len(t) AS len, weight FROM f), post AS (SELECT id, field, " + _STEM.format("word") + " AS term, count(*) AS tf FROM (SELECT id, field, unnest(t) AS word FROM f) GROUP BY ALL), avgs AS (SELECT field, avg(len) AS avgdl FROM lens GROUP BY field)"
_BM = "m AS (SELECT q.query_id, p.id, p.field, p.term, l.weight * p.tf / (1 - 0.75 + 0.75 * l.len / a.avgdl) AS wtf FROM post p JOIN q USING (term) JOIN lens l USING (id, field) JOIN avgs a USING (field)), dfs AS (SELECT query_id, term, count(DISTINCT id) AS df FROM m GROUP BY ALL), tt AS (SELECT m.query_id, id, term, df, ln(1 + ((SELECT count(*) FROM part) - df + 0.5) / (df + 0.5)) AS idf, sum(wtf) AS tilde FROM m JOIN dfs USING (query_id, term) GROUP BY ALL), ex AS (SELECT *, idf * tilde / (1.2 + tilde) AS c FROM tt), sc AS (SELECT query_id, id, sum(c) AS score FROM ex GROUP BY ALL HAVING sum(c) > 0)"
_QUERY = "Large economies, small brass"
_Q = "q(query_id, term) AS (VALUES (0, 'larg'), (0, 'economi'), (0, 'small'), (0, 'brass'))"


def _index(g):
    return search.Index(g.scan_class("Part", _PART), g.registry.weights_of("Part"))


def _kept(g):
    """The same, saved once and searched many times."""
    return search.kept_index(g.scan_class("Part", _PART), g.registry.weights_of("Part"))


def _texts(g):
    """One full-text field's words as they are, of all documents."""
    assert g.registry.slots["text"].fulltext
    return search.kept_index(g.scan_class("Document", ["text"]), {"text": 1.0}, stem=False, varied=False)


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("h1_raw_tokens", f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)", graph=False)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", search.raw_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("terms"))


@query("h1_all_tokens", f"SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)", graph=False)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", search.raw_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.posexplode("t").alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@query("h2_stemmed_tokens")
def _(g):
    return search.term_counts(g.scan_class("Document", ["text"]), ["text"], stem=True)


@query("h2_stemmed_parts", f"WITH {_HSQL} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY term")
def _(g):
    return search.term_counts(g.scan_class("Part", _PART), _PART, stem=True)


@query("h3_postings", f"WITH {_HSQL} SELECT id, field, term, tf FROM post")
def _(g):
    return _index(g).postings


@query("h4_corpus_stats", f"WITH {_HSQL} SELECT 'df' AS what, term AS name, CAST(count(DISTINCT id) AS DOUBLE) AS value FROM post GROUP BY term UNION ALL SELECT 'avgdl', field, round(avgdl, 6) FROM avgs UNION ALL SELECT 'n', '', count(*) FROM part")
def _(g):
    i = _index(g)
    df = search.document_frequencies(i.postings).select(F.lit("df").alias("what"), F.col("term").alias("name"), F.col("df").cast("double").alias("value"))
    avg = search.average_lengths(i.lengths).select(F.lit("avgdl"), "field", F.round("avgdl", 6))
    return df.union(avg).union(i.n.select(F.lit("n"), F.lit(""), F.col("n_docs").cast("double")))


@query("h5_bm25f_score", f"WITH {_HSQL}, {_Q}, {_BM} SELECT id, round(score, 6) AS score FROM sc")
def _(g):
    return _r(_kept(g).score(_QUERY), "score").select("id", "score")


@query("h5_saved_index", f"WITH {_HSQL}, {_Q}, {_BM} SELECT id, round(score, 6) AS score FROM sc")
def _(g):
    from entigraph.scratch import new_path

    at = new_path(g.spark, "index")
    _index(g).save(at)
    return _r(_index(g).load(at).score(_QUERY), "score").select("id", "score")


@query("h6_bm25f_explain", f"WITH {_HSQL}, {_Q}, {_BM} SELECT id, term, df, round(idf, 6) AS idf, round(tilde, 6) AS tilde_tf, round(c, 6) AS contribution FROM ex")
def _(g):
    return _r(_kept(g).explain(_QUERY), "idf", "tilde_tf", "contribution").drop("query_id")


@query("h7_search_bm25f", f"WITH {_HSQL}, {_Q}, {_BM} SELECT id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 20")
def _(g):
    return _r(search.best(_kept(g).score(_QUERY).withColumn("score", F.round("score", 9)), 20), "score").select("id", "score")


@query("h8_field_weights", f"WITH {_HSQL.replace('12.0 AS weight', '1.0 AS weight').replace('8.0 AS weight', '5.0 AS weight')}, {_Q}, {_BM} SELECT id, round(score, 6) AS score FROM sc")
def _(g):
    return _r(_kept(g).score(_QUERY, {"p_name": 1.0, "p_type": 5.0, "p_brand": 1.0}), "score").select("id", "score")


@query("h9_search_where", f"WITH {_HSQL}, {_Q}, {_BM} SELECT id, round(score, 6) AS score FROM sc WHERE id IN (SELECT 'Part/' || p_partkey FROM part WHERE p_size <= 10)")
def _(g):
    return _r(_kept(g).score(_QUERY, where=g.where("Part", ("p_size", "<=", 10), slots=["p_size"])), "score").select("id", "score")


@query("h10_field_scores", f"WITH {_HSQL}, {_Q}, {_BM} SELECT id, field, round(sum(idf * wtf / (1.2 + wtf)), 6) AS score FROM m JOIN (SELECT DISTINCT query_id, term, idf FROM tt) USING (query_id, term) GROUP BY ALL")
def _(g):
    return _r(_kept(g).field_scores(_QUERY), "score").drop("query_id")


_LEAST = "CASE WHEN instr(lower(text), 'the') > 0 AND (instr(lower(text), 'and') = 0 OR instr(lower(text), 'the') < instr(lower(text), 'and')) THEN instr(lower(text), 'the') WHEN instr(lower(text), 'and') > 0 THEN instr(lower(text), 'and') END"


@query("h11_snippets", f"WITH a AS (SELECT doc_id, text, {_LEAST} AS pl FROM documents), w AS (SELECT *, greatest(pl - 120, 1) AS b, least(pl - 1 + 120, length(text)) AS e FROM a WHERE pl IS NOT NULL) SELECT doc_id, CASE WHEN b > 1 THEN '...' ELSE '' END || regexp_replace(regexp_replace(substr(text, b, e - b + 1), 'the', '**\\0**', 'gi'), 'and', '**\\0**', 'gi') || CASE WHEN e < length(text) THEN '...' ELSE '' END AS snippet FROM w", graph=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), "the and").alias("snippet")).where("snippet is not null")


@query("h12_search_facets", f"WITH {_HSQL}, {_Q}, {_BM} SELECT 'p_brand' AS slot, p_brand AS value, count(*) AS n FROM sc JOIN part ON id = 'Part/' || p_partkey GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM sc JOIN part ON id = 'Part/' || p_partkey GROUP BY 2")
def _(g):
    hits = _kept(g).score(_QUERY).select("id")
    return aggregate.facets(g.scan_class("Part", ["p_brand", "p_size"]).join(hits, "id", "left_semi"), ["p_brand", "p_size"])


_DOC = f"f AS (SELECT 'Document/' || doc_id AS id, {_TOK.format('text')} AS t FROM documents), post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM f) GROUP BY ALL), a AS (SELECT avg(len(t)) AS avgdl, count(*) AS n FROM f), q(term) AS (VALUES ('the'), ('heat'), ('trash')), dfs AS (SELECT term, count(*) AS df FROM post JOIN q USING (term) GROUP BY term), m AS (SELECT id, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf / (1 - 0.75 + 0.75 * len(t) / avgdl) AS x FROM post JOIN dfs USING (term) JOIN f USING (id), a)"


@query("h13_search_field", f"WITH {_DOC} SELECT id, round(sum(idf * x / (1.2 + x)), 6) AS score FROM m GROUP BY id")
def _(g):
    return _r(_texts(g).score("the heat trash"), "score").select("id", "score")


@query("h14_term_conditions", f"WITH f AS (SELECT 'Document/' || doc_id AS id, {_TOK.format('text')} AS t FROM documents), p AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM f) SELECT DISTINCT id FROM p a WHERE id IN (SELECT id FROM p WHERE term = 'the') AND id IN (SELECT id FROM p WHERE term = 'and') AND id NOT IN (SELECT id FROM p WHERE term = 'stupid') AND id IN (SELECT x.id FROM p x JOIN p y ON x.id = y.id AND y.pos = x.pos + 1 WHERE x.term = 'of' AND y.term = 'the') AND id IN (SELECT id FROM p WHERE starts_with(term, 'ther')) AND id IN (SELECT id FROM p WHERE levenshtein(term, 'thened') <= 2)")
def _(g):
    i = _texts(g)
    return search.matching(i, all_of=["The", "and"], none_of=["Stupid"], phrase="Of the", prefix="Ther", fuzzy="thened")


@query("h14_fuzzy_prefix", "WITH w AS (SELECT 'Part/' || p_partkey AS id, unnest(string_split_regex(trim(lower(p_name || ' ' || p_type)), '\\s+')) AS word FROM part) SELECT DISTINCT id FROM w WHERE levenshtein(word, 'bleu') <= 2 AND id IN (SELECT id FROM w WHERE levenshtein(word, 'wigets') <= 2) AND id IN (SELECT id FROM w WHERE starts_with(word, 'eco'))")
def _(g):
    near = [search.matching(_kept(g), fuzzy=word, distance=d, prefix="ECO") for word, d in (("bleu", 2), ("Wigets", 2))]
    return near[0].join(near[1], "id", "left_semi")


@query("h14_stemmed_conditions", "SELECT 'Part/' || p_partkey AS id FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), '\\blarge\\b') AND NOT regexp_matches(lower(p_name), '\\bbolt\\b')")
def _(g):
    return search.matching(_kept(g), all_of=["LARGE"], none_of=["bolts"])


@query("h15_multi_query", f"WITH {_HSQL}, q AS (SELECT DISTINCT query_id, {_STEM.format('word')} AS term FROM (SELECT p_partkey AS query_id, unnest({_TOK.format('p_type')}) AS word FROM part WHERE p_partkey % 50 = 0)), {_BM}, rk AS (SELECT query_id, id, round(score, 9) AS score FROM sc) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rk) WHERE rank <= 5")
def _(g):
    q = g.scan_class("Part", ["p_type"]).select(F.expr("cast(substring(id, 6) as long)").alias("query_id"), F.col("p_type").alias("query")).where("query_id % 50 = 0")
    return _r(_kept(g).top(q, 5), "score")


# I: validation


def _raw_orders(g):
    """Orders as raw strings, some of them broken."""
    k = F.expr("cast(substring(id, 7) as long)")
    return g.scan_class("Order").select(
        "id", F.when(k % 11 == 0, None).when(k % 13 == 0, "Customer/none").otherwise(F.col("placed_by")).alias("placed_by"),
        F.when(k % 17 == 0, "much").otherwise("1.5").alias("totalprice"), F.when(k % 19 == 0, F.array(F.lit("O"), F.lit("F"))).otherwise(F.array("orderstatus")).alias("orderstatus"),
    )


_I = {
    "missing": "SELECT 'Order/' || o_orderkey AS id, 'placed_by' AS slot, 'missing-required' AS error FROM orders WHERE o_orderkey % 11 = 0",
    "type": "SELECT 'Order/' || o_orderkey AS id, 'totalprice' AS slot, 'invalid-type' AS error FROM orders WHERE o_orderkey % 17 = 0",
    "cardinality": "SELECT 'Order/' || o_orderkey AS id, 'orderstatus' AS slot, 'invalid-cardinality' AS error FROM orders WHERE o_orderkey % 19 = 0",
    "reference": "SELECT 'Order/' || o_orderkey AS id, 'placed_by' AS slot, 'invalid-reference' AS error FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0",
}
for _n, _k, _e in (("i1_missing_required", "missing", "missing-required"), ("i2_invalid_type", "type", "invalid-type"), ("i3_cardinality", "cardinality", "invalid-cardinality")):
    query(_n, _I[_k])(lambda g, e=_e: validate.validate_data(_raw_orders(g), g.registry, "Order").where(F.col("error") == e))


@query("i4_class_errors", "SELECT 'Supplier/' || s_suppkey AS id, 'class' AS slot, CASE s_suppkey % 4 WHEN 0 THEN 'no-class' WHEN 1 THEN 'unknown-class' ELSE 'abstract-class' END AS error FROM supplier WHERE s_suppkey % 4 <> 3")
def _(g):
    k = F.expr("cast(substring(id, 10) as long) % 4")
    rows = g.scan_class("Supplier", []).select("id", F.when(k == 1, "Nothing").when(k == 2, "Party").when(k == 3, "Supplier").alias("class"))
    return validate.class_errors(rows, classes(g)[0])


@query("i5_custom_validator", "SELECT 'Part/' || p_partkey AS id, '' AS slot, 'too large' AS error FROM part WHERE p_size > 45")
def _(g):
    return validate.validate(g.scan_class("Part"), g.registry, "Part", validators={"Part": lambda: F.when(F.col("p_size") > 45, "too large")})


def _size_rule(row):
    return "too large" if 100 // (row["p_size"] % 7) < 0 or row["p_size"] > 45 else None


@query("i5_failing_validator", "SELECT 'Part/' || p_partkey AS id, '' AS slot, CASE WHEN p_size % 7 = 0 THEN 'validator-error: ZeroDivisionError' ELSE 'too large' END AS error FROM part WHERE p_size > 45 OR p_size % 7 = 0")
def _(g):
    rule = lambda: per_row(_size_rule, ["p_size"], "string", validate.failure)
    return validate.validate(g.scan_class("Part", ["p_size"]), g.registry, "Part", validators={"Part": rule})


@query("i6_validate", " UNION ALL ".join(_I.values()))
def _(g):
    return validate.validate(_raw_orders(g), g.registry, "Order", {"placed_by": g.scan_class("Customer", [])})


@query("i7_validate_data", " UNION ALL ".join(_I[k] for k in ("missing", "type", "cardinality")))
def _(g):
    return validate.validate_data(_raw_orders(g), g.registry, "Order")


@query("i8_validate_all", "SELECT count(*) AS total, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS invalid FROM (SELECT o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS bad FROM orders)")
def _(g):
    return validate.validate_all(_raw_orders(g), g.registry, "Order", {"placed_by": g.scan_class("Customer", [])})


@query("i9_validation_run", "SELECT 'Order' AS class, 'failed' AS state, count(*) AS total, count(*) FILTER (o_orderkey % 11 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0) AS invalid FROM orders UNION ALL SELECT 'Customer', 'passed', count(*), 0 FROM customer")
def _(g):
    from entigraph.scratch import new_path

    at = new_path(g.spark, "runs")
    for name, rows in (("Order", _raw_orders(g)), ("Customer", g.scan_class("Customer"))):
        validate.validation_run(g.spark, at, f"run-{name}", name, lambda name=name, rows=rows: validate.validate_all(rows, g.registry, name))
    return validate.recent_validations(g.spark.read.parquet(at)).select("class", "state", "total", "invalid")


@query("i10_recent_validations", "SELECT 'Order/' || o_orderkey AS run_id, o_orderstatus AS state FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, run_id LIMIT 10")
def _(g):
    runs = g.scan_class("Order").select(F.col("id").alias("run_id"), F.lit("Order").alias("class"), F.col("orderstatus").alias("state"), F.col("orderdate").alias("started"))
    return validate.recent_validations(runs, "Order", "F").select("run_id", "state")


# J: changes


def _versions(g):
    old = g.scan_class("Order").select("id", "orderstatus", "orderpriority", "totalprice")
    k = F.expr("cast(substring(id, 7) as long)")
    new = old.where(k % 11 != 0).withColumn("orderstatus", F.when(k % 7 == 0, F.concat(F.lit("x"), "orderstatus")).otherwise(F.col("orderstatus")))
    return old, new.union(old.where(k % 100 == 1).withColumn("id", F.regexp_replace("id", "/", "/-")))


_JNEW = "old AS (SELECT o_orderkey AS k, 'Order/' || o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t FROM orders), new AS (SELECT k, id, CASE WHEN k % 7 = 0 THEN 'x' || s ELSE s END AS s, p, t FROM old WHERE k % 11 <> 0 UNION ALL SELECT -k, 'Order/-' || k, s, p, t FROM old WHERE k % 100 = 1)"
_JDIFF = f"{_JNEW}, diff AS (SELECT id, '*' AS op, 'orderstatus' AS path, o.s AS old_value, n.s AS new_value FROM old o JOIN new n USING (id) WHERE o.s <> n.s UNION ALL SELECT id, '-', unnest(['orderstatus', 'orderpriority']), unnest([s, p]), NULL FROM old WHERE k % 11 = 0 UNION ALL SELECT id, '+', unnest(['orderstatus', 'orderpriority']), NULL, unnest([s, p]) FROM new WHERE k < 0)"


def _diff(g):
    old, new = _versions(g)
    return changes.diff_snapshots(old.drop("totalprice"), new.drop("totalprice"))


@query("j1_diff_snapshots", f"WITH {_JDIFF} SELECT * FROM diff")
def _(g):
    return _diff(g)


@query("j2_patch", f"WITH {_JNEW} SELECT id, s AS orderstatus, p AS orderpriority, t AS totalprice FROM new")
def _(g):
    old, new = _versions(g)
    return changes.patch(old, changes.diff_snapshots(old, new))


def _nested_versions(spark, sf_dir):
    """Orders with a struct, a map (kinds of lines, with their number) and an array of their lines, before and after some lines went and some quantities rose."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("info"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").cast("long").alias("part"), F.col("l_quantity").cast("long").alias("qty"), F.concat("l_returnflag", "l_linestatus").alias("mode"))

    def version(orders, lines):
        # an order's lines come together once: their kinds are counted within its row
        each = lines.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "part", "qty", "mode"))).alias("ls"))
        kinds = F.transform("ls", lambda x: x["mode"])
        counted = F.transform(F.array_distinct(kinds), lambda m: F.struct(m.alias("mode"), F.size(F.filter("ls", lambda x: x["mode"] == m)).cast("long").alias("c")))
        each = each.withColumn("modes", F.map_from_entries(counted))
        ls = F.transform(F.coalesce("ls", F.array().cast("array<struct<n:bigint,part:bigint,qty:bigint,mode:string>>")), lambda x: F.struct(x["part"].alias("part"), x["qty"].alias("qty")))
        out = orders.join(each, "k", "left")
        return out.select(F.concat(F.lit("Order/"), F.col("k").cast("string")).alias("id"), "info", F.coalesce("modes", F.create_map().cast("map<string,bigint>")).alias("modes"), ls.alias("lines"))

    status = F.when(F.col("k") % 7 == 0, F.concat(F.lit("x"), F.col("info.status"))).otherwise(F.col("info.status"))
    later = o.where("k % 11 <> 0").withColumn("info", F.struct(status.alias("status"), F.col("info.priority").alias("priority")))
    rest = lines.where("(k + n) % 5 <> 0 and k % 11 <> 0").withColumn("qty", F.col("qty") + F.when(F.col("part") % 3 == 0, 1).otherwise(0))
    return version(o, lines), version(later, rest)


_NESTED = """ln AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty, l_returnflag || l_linestatus AS mode FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
 l1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, part, qty) - 1 AS i FROM ln),
 l2 AS (SELECT k, n, part, qty + CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS qty, mode, row_number() OVER (PARTITION BY k ORDER BY n, part, qty) - 1 AS i FROM ln WHERE (k + n) % 5 <> 0 AND k % 11 <> 0),
 m1 AS (SELECT k, mode, count(*) AS c FROM ln GROUP BY k, mode), m2 AS (SELECT k, mode, count(*) AS c FROM l2 GROUP BY k, mode)"""

def _json_of(m: str, lines: str) -> str:
    return f"""SELECT o_orderkey AS k, '{{' || coalesce((SELECT string_agg('"' || mode || '":"' || c || '"', ',' ORDER BY mode) FROM {m} WHERE {m}.k = o_orderkey), '') || '}}' AS modes,
 '[' || coalesce((SELECT string_agg('{{"part":"' || part || '","qty":"' || qty || '"}}', ',' ORDER BY i) FROM {lines} WHERE {lines}.k = o_orderkey), '') || ']' AS lines FROM orders"""


@query("j1_nested_diff", f"""WITH {_NESTED}, gone AS ({_json_of("m1", "l1")} WHERE o_orderkey % 11 = 0), d AS (
 SELECT o_orderkey AS k, '*' AS op, 'info.status' AS path, o_orderstatus AS old_value, 'x' || o_orderstatus AS new_value FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0
 UNION ALL SELECT k, CASE WHEN m2.c IS NULL THEN '-' ELSE '*' END, 'modes["' || mode || '"]', CAST(m1.c AS VARCHAR), CAST(m2.c AS VARCHAR) FROM m1 LEFT JOIN m2 USING (k, mode) WHERE k % 11 <> 0 AND m1.c IS DISTINCT FROM m2.c
 UNION ALL SELECT k, '*', 'lines[' || i || '].part', CAST(l1.part AS VARCHAR), CAST(l2.part AS VARCHAR) FROM l1 JOIN l2 USING (k, i) WHERE l1.part <> l2.part
 UNION ALL SELECT k, '*', 'lines[' || i || '].qty', CAST(l1.qty AS VARCHAR), CAST(l2.qty AS VARCHAR) FROM l1 JOIN l2 USING (k, i) WHERE l1.qty <> l2.qty
 UNION ALL SELECT k, '-', 'lines[' || i || ']', '{{"part":"' || l1.part || '","qty":"' || l1.qty || '"}}', NULL FROM l1 LEFT JOIN l2 USING (k, i) WHERE k % 11 <> 0 AND l2.k IS NULL
 UNION ALL SELECT o_orderkey, '-', unnest(['info.status', 'info.priority']), unnest([o_orderstatus, o_orderpriority]), NULL FROM orders WHERE o_orderkey % 11 = 0
 UNION ALL SELECT k, '-', unnest(['modes', 'lines']), unnest([modes, lines]), NULL FROM gone)
 SELECT 'Order/' || k AS id, op, path, old_value, new_value FROM d""", graph=False)  # fmt: skip
def _(spark, sf_dir):
    return changes.diff_snapshots(*_nested_versions(spark, sf_dir))


@query("j2_nested_patch", f"""WITH {_NESTED}, now AS ({_json_of("m2", "l2")} WHERE o_orderkey % 11 <> 0)
 SELECT 'Order/' || k AS id, CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END || o_orderstatus AS status, o_orderpriority AS priority, modes, lines FROM now JOIN orders ON o_orderkey = k""", graph=False)  # fmt: skip
def _(spark, sf_dir):
    old, new = _nested_versions(spark, sf_dir)
    out = changes.patch(old, changes.diff_snapshots(old, new))
    text = lambda c: changes.as_text(F.col(c), out.schema[c].dataType).alias(c)
    return out.select("id", "info.status", "info.priority", text("modes"), text("lines"))


def _audit(g):
    return changes.audit_changes(_diff(g), "batch", "nightly", "api", "c-1", "Order")


@query("j3_audit_changes", f"WITH {_JDIFF} SELECT 'Update' AS class, id AS entity, path AS attribute, old_value, new_value, NULL AS initial_data, NULL AS final_data, 'api' AS source FROM diff WHERE op = '*' UNION ALL SELECT CASE op WHEN '+' THEN 'Create' ELSE 'Delete' END, id, NULL, NULL, NULL, CASE op WHEN '+' THEN j END, CASE op WHEN '-' THEN j END, 'api' FROM (SELECT id, op, '{{' || string_agg('\"' || path || '\":\"' || coalesce(new_value, old_value) || '\"', ',' ORDER BY path) || '}}' AS j FROM diff WHERE op <> '*' GROUP BY ALL)")
def _(g):
    return _audit(g).select("class", "entity", "attribute", "old_value", "new_value", "initial_data", "final_data", "source")


@query("j4_audit_query", f"WITH {_JDIFF} SELECT DISTINCT id AS entity FROM diff WHERE op = '-'")
def _(g):
    return changes.audit_query(_audit(g), **{"class": "Delete"}, source="api", entity_type="Order", correlation_id="c-1").select("entity")


# K: events


def _log(g):
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return g.scan_class("Event").select("id", "ts", F.col("event_type").alias("kind"), level.alias("level"), F.col("user_id").alias("correlation_id"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("k1_normalize_events", "SELECT 'Event/' || event_id AS id, event_type AS kind, CASE event_id % 5 WHEN 0 THEN 'unknown-class' WHEN 1 THEN 'bad-timestamp' END AS reject, CASE WHEN event_id % 5 = 1 THEN TIMESTAMP '2030-01-01' ELSE ts END AS at, 'a,' || event_type AS tags FROM events", graph=False)
def _(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    raw = e.select(F.concat(F.lit("Event/"), F.col("event_id").cast("string")).alias("id"), F.when(k == 0, "Nothing").otherwise("UserEvent").alias("class"), F.when(k == 1, "soon").otherwise(F.col("ts").cast("string")).alias("timestamp"), F.concat(F.lit(":"), "event_type").alias("kind"), F.concat("event_type", F.lit(", a ,a")).alias("tags"), F.lit(None).cast("string").alias("correlation_id"))
    out = events.normalize_events(raw, F.to_timestamp(F.lit("2030-01-01")))
    return out.select("id", "kind", "reject", F.col("timestamp").cast("timestamp_ntz").alias("at"), F.array_join("tags", ",").alias("tags"))


@query("k2_list_events", "SELECT 'Event/' || event_id AS id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, id LIMIT 100")
def _(g):
    return events.list_events(_log(g), level="error").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("k3_correlations", "SELECT user_id AS correlation_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id")
def _(g):
    return events.correlations(_log(g)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


_HTTP = "SELECT 'Event/' || event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 200 + 100 * (event_id % 4) END AS s, CAST(trunc(value * 10) AS BIGINT) AS d, CASE WHEN event_id % 3 = 0 THEN '/api/event/x' ELSE '/page' END AS path FROM events"


def _requests(g):
    k = F.expr("cast(substring(id, 7) as long)")
    r = _log(g).select("id", F.when(k % 10 == 0, None).otherwise(200 + 100 * (k % 4)).alias("status_code"), F.col("ts").alias("started"), F.when(k % 3 == 0, "/api/event/x").otherwise("/page").alias("path"), "value")
    return events.http_events(r.withColumn("finished", F.timestamp_millis(F.unix_millis("started") + F.expr("cast(value * 10 as bigint)"))))


@query("k4_http_events", f"SELECT id, CASE WHEN s IS NULL THEN 'error' WHEN s < 400 THEN 'info' WHEN s < 500 THEN 'warn' ELSE 'error' END AS level, d AS duration FROM ({_HTTP})")
def _(g):
    return _requests(g).select("id", "level", "duration")


@query("k5_notable_requests", f"SELECT id, CASE WHEN s >= 500 AND d > 1000 THEN 'error,slow' WHEN s >= 500 THEN 'error' ELSE 'slow' END AS tags FROM ({_HTTP}) WHERE path = '/page' AND (s >= 500 OR d > 1000)")
def _(g):
    return events.notable_requests(_requests(g)).select("id", F.array_join("tags", ",").alias("tags"))


@query("k6_event_tree", "SELECT 'Event/' || event_id AS node, CAST(event_id % 4 AS INTEGER) AS hop, 'Event/' || (event_id - event_id % 4) AS seed FROM events WHERE event_id % 4 <> 0 AND (event_id - event_id % 4) IN (SELECT event_id FROM events)")
def _(g):
    k = F.expr("cast(substring(id, 7) as long)")
    rows = g.scan_class("Event", []).select("id", F.when(k % 4 != 0, F.concat(F.lit("Event/"), (k - 1).cast("string"))).alias("parent"))
    return events.event_tree(rows.where(F.expr("cast(substring(id, 7) as long) % 4 = 0")), rows).select("node", "hop", "seed")


# L: workflow

# two workflows that share names of states and actions
STATES = [
    ("w", "new", "New", True, False, None), ("w", "active", "Active", False, False, None), ("w", "buyer", "Buyer", False, True, "success"), ("w", "blocked", "Blocked", False, True, "cancel"), ("w", "lost", "Lost", False, False, None),
    ("v", "new", "Opened", True, False, None), ("v", "active", "In use", False, False, None), ("v", "blocked", "On hold", False, False, None), ("v", "gone", "Gone", False, True, "cancel"),
]
MOVES = [
    ("w", "signup", "new", "active", None, False), ("w", "click", "active", "active", None, False), ("w", "purchase", "active", "buyer", "large", False), ("w", "error", "active", "blocked", "large", True), ("w", "error", "new", "blocked", "unknown", False),
    ("v", "view", "new", "active", None, False), ("v", "error", "active", "blocked", None, False), ("v", "click", "blocked", "active", None, True), ("v", "purchase", "active", "gone", "large", False), ("v", "error", "new", "gone", "large", True),
]
GUARDS = {"large": lambda: F.col("value") > 200}
_STATES_SQL = "states(workflow, state, label, initial, terminal, terminal_kind) AS (VALUES " + ", ".join("('{}', '{}', '{}', {}, {}, {})".format(w, s, n, str(i).lower(), str(t).lower(), f"'{k}'" if k else "NULL") for w, s, n, i, t, k in STATES) + ")"
_MOVES_SQL = "moves(workflow, name, from_state, to_state, guard, needs) AS (VALUES " + ", ".join("('{}', '{}', '{}', '{}', {}, {})".format(w, n, a, b, f"'{g}'" if g else "NULL", str(r).lower()) for w, n, a, b, g, r in MOVES) + ")"


def _states(g):
    return g.spark.createDataFrame(STATES, "workflow string, state string, label string, initial boolean, terminal boolean, terminal_kind string")


def _moves(g):
    return g.spark.createDataFrame(MOVES, "workflow string, name string, from_state string, to_state string, guard string, requires_reason boolean")


_FOLD = f"""{_STATES_SQL}, {_MOVES_SQL}, l AS (SELECT 'p' || user_id AS process, CASE WHEN user_id % 2 = 0 THEN 'w' ELSE 'v' END AS workflow, event_type AS action, value, event_id % 3 = 0 AS given, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
fold AS (SELECT process, workflow, 0 AS seq, CAST(NULL AS VARCHAR) AS action, 'new' AS from_state, 'new' AS to_state, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS why FROM (SELECT DISTINCT process, workflow FROM l)
UNION ALL SELECT process, workflow, seq, action, before, CASE WHEN why IS NULL THEN target ELSE before END, ts, why FROM (
  SELECT f.process, f.workflow, f.seq + 1 AS seq, l.action, f.to_state AS before, m.to_state AS target, l.ts,
    CASE WHEN m.name IS NULL THEN 'no such transition' WHEN m.needs AND NOT l.given THEN 'reason missing' WHEN m.guard = 'large' AND l.value > 200 THEN NULL WHEN m.guard IS NOT NULL THEN 'guard not met' END AS why
  FROM fold f JOIN l ON l.process = f.process AND l.seq = f.seq + 1 LEFT JOIN moves m ON m.workflow = l.workflow AND m.name = l.action AND m.from_state = f.to_state)),
history AS (SELECT *, why IS NULL AS accepted FROM fold WHERE seq > 0), last AS (SELECT process, workflow, coalesce(arg_max(to_state, seq) FILTER (accepted), 'new') AS state, max(ts) FILTER (accepted) AS done_at FROM history GROUP BY ALL),
procs AS (SELECT process, workflow, state, terminal, terminal_kind, CASE WHEN terminal THEN done_at END AS completed_at, CAST(substr(process, 2) AS BIGINT) % 10 AS value FROM last JOIN states USING (workflow, state))"""


def _requested(g):
    from pyspark.sql import Window

    user, event = F.col("user_id"), F.expr("cast(substring(id, 7) as long)")
    e = g.scan_class("Event").select(F.concat(F.lit("p"), user.cast("string")).alias("process"), F.when(user % 2 == 0, "w").otherwise("v").alias("workflow"), "ts", F.col("event_type").alias("action"), event.alias("event_id"), "value")
    seq = F.row_number().over(Window.partitionBy("process").orderBy("ts", "event_id"))
    return e.withColumn("seq", seq).withColumn("reason", F.when(F.col("event_id") % 3 == 0, "why not"))


def _history(g):
    return workflow.replay_transitions(_requested(g), _moves(g), _states(g), GUARDS)


def _processes(g):
    s = workflow.current_states(_history(g), _states(g))
    return s.select(F.col("process").alias("id"), "workflow", "current_state", "completed_at", F.lit(None).cast("timestamp").alias("started_at"), F.col("process").alias("subject"), F.expr("cast(substring(process, 2) as long) % 10 as value"))


#: Of processes: the last digit of their number.
PROCESS_GUARDS = {"large": lambda: F.col("value") > 4}


@query("l1_check_workflows", "SELECT 'Nation/' || n_nationkey AS workflow, CASE n_nationkey % 3 WHEN 0 THEN 'end' WHEN 1 THEN 'start' ELSE 'go' END AS subject, CASE n_nationkey % 3 WHEN 0 THEN 'terminal-without-kind' WHEN 1 THEN 'kind-without-terminal' ELSE 'unknown-to' END AS violation FROM nation")
def _(g):
    n = g.scan_class("Nation", []).select(F.col("id").alias("workflow"), F.expr("cast(substring(id, 8) as int) % 3").alias("k"))
    s = n.select("workflow", F.lit("start").alias("state"), F.lit(False).alias("terminal"), F.when(F.col("k") == 1, "success").alias("terminal_kind")).union(n.select("workflow", F.lit("end"), F.lit(True), F.when(F.col("k") != 0, "success")))
    m = n.select("workflow", F.lit("go").alias("name"), F.lit("start").alias("from_state"), F.when(F.col("k") == 2, "nowhere").otherwise("end").alias("to_state"))
    return workflow.check_workflows(s, m)


_OPEN = "procs p JOIN moves m ON m.workflow = p.workflow AND state = from_state AND (guard IS NULL OR guard = 'large' AND value > 4)"


@query("l2_available_transitions", f"WITH RECURSIVE {_FOLD} SELECT process AS id, name FROM {_OPEN}")
def _(g):
    return workflow.available_transitions(_processes(g), _moves(g), PROCESS_GUARDS).select("id", "name")


@query("l3_replay_transitions", f"WITH RECURSIVE {_FOLD} SELECT process, workflow, CAST(seq AS BIGINT) AS seq, action, from_state, to_state, accepted, why FROM history")
def _(g):
    return _history(g).select("process", "workflow", F.col("seq").cast("long").alias("seq"), "action", "from_state", "to_state", "accepted", "why")


@query("l4_process_history", f"WITH RECURSIVE {_FOLD} SELECT h.process, CAST(h.seq AS BIGINT) AS seq, action, a.label AS from_label, b.label AS to_label FROM history h JOIN states a ON a.workflow = h.workflow AND a.state = from_state JOIN states b ON b.workflow = h.workflow AND b.state = to_state WHERE accepted")
def _(g):
    return workflow.process_history(_history(g), _states(g)).select("process", F.col("seq").cast("long").alias("seq"), "action", "from_label", "to_label")


@query("l5_processes", f"WITH RECURSIVE {_FOLD} SELECT process AS id, state AS current_state FROM procs WHERE completed_at IS NULL")
def _(g):
    return workflow.processes(_processes(g), active=True, limit=0).select("id", "current_state")


@query("l6_outcome_status", f"WITH RECURSIVE {_FOLD} SELECT process AS id, CASE WHEN NOT terminal THEN 'running' WHEN terminal_kind = 'cancel' THEN 'cancelled' ELSE 'completed' END AS status FROM procs UNION ALL SELECT 'x' || n_nationkey, 'missing' FROM nation")
def _(g):
    p = _processes(g)
    asked = p.select("id").union(g.scan_class("Nation", []).select(F.concat(F.lit("x"), F.expr("substring(id, 8)"))))
    return workflow.outcome_status(asked, p, _states(g))


@query("l7_cancellable", f"WITH RECURSIVE {_FOLD} SELECT DISTINCT process AS id FROM {_OPEN} JOIN states s ON s.workflow = p.workflow AND s.state = m.to_state WHERE s.terminal_kind = 'cancel'")
def _(g):
    return workflow.cancellable(_processes(g), _moves(g), _states(g), PROCESS_GUARDS)


@query("l8_workflow_reachability", "SELECT 'Nation/' || n_nationkey AS workflow, unnest(['a', 'b', 'c']) AS state, unnest([true, n_nationkey % 2 = 0, false]) AS reachable, unnest([n_nationkey % 2 <> 0, false, true]) AS dead_end FROM nation")
def _(g):
    n = g.scan_class("Nation", []).select(F.col("id").alias("workflow"), F.expr("cast(substring(id, 8) as int) % 2 = 0").alias("even"))
    s = n.select("workflow", F.explode(F.array(*[F.struct(F.lit(x).alias("state"), F.lit(x == "a").alias("initial"), F.lit(x == "b").alias("terminal")) for x in "abc"])).alias("s")).select("workflow", "s.*")
    m = n.where("even").select("workflow", F.lit("go").alias("name"), F.lit("a").alias("from_state"), F.lit("b").alias("to_state"))
    return workflow.workflow_reachability(s, m).select("workflow", "state", "reachable", "dead_end")


@query("d11_workflow_stats", f"WITH RECURSIVE {_FOLD} SELECT state, count(*) AS n, count(completed_at) AS n_completed, count(*) - count(completed_at) AS n_active FROM procs GROUP BY ROLLUP (state)")
def _(g):
    return workflow.workflow_stats(_processes(g))


# M: jobs


def _jobs(g):
    o = g.scan_class("Order")
    status = F.when(F.col("orderstatus") == "O", "pending").when(F.col("orderstatus") == "P", "running").otherwise("completed")
    priority = F.expr("cast(substring(orderpriority, 1, 1) as int)")
    return o.select("id", status.alias("status"), F.col("orderpriority").alias("queue"), (-priority).alias("priority"), F.col("orderdate").alias("run_at"), F.lit(None).cast("timestamp").alias("next_run"), F.array("orderpriority", "orderstatus").alias("tags"))


_JOBS = "jobs AS (SELECT 'Order/' || o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderpriority AS queue, -CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS run_at FROM orders)"


@query("m1_jobs", f"WITH {_JOBS} SELECT id, status, priority FROM jobs WHERE status IN ('pending', 'running') ORDER BY priority DESC, id LIMIT 100")
def _(g):
    return jobs.jobs(_jobs(g)).select("id", "status", "priority")


@query("e3_poll_queue", f"WITH {_JOBS} SELECT id FROM jobs WHERE status = 'pending' AND queue = '2-HIGH' ORDER BY priority DESC, id LIMIT 10")
def _(g):
    return jobs.poll_queue(_jobs(g), "2-HIGH").select("id")


@query("m2_due_jobs", f"WITH {_JOBS} SELECT id FROM jobs WHERE status = 'pending' AND run_at <= TIMESTAMP '1997-06-01'")
def _(g):
    return jobs.due_jobs(_jobs(g), "1997-06-01 00:00:00").select("id")


_RUNS = "runs AS (SELECT 'Order/' || l_orderkey AS job, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status, l_shipdate AS finished_at, l_linenumber AS attempt, CAST(l_quantity AS BIGINT) * 100 AS duration_ms FROM lineitem)"


def _runs(g, sf=None):
    li = g.sources["LineItem"]
    return li.select(F.col("line_of").alias("job"), F.when(F.expr("quantity > 30"), "failed").otherwise("completed").alias("status"), F.col("shipdate").alias("finished_at"), F.col("shipdate").alias("started_at"), F.expr("cast(substring_index(id, '-', -1) as int)").alias("attempt"), (F.col("quantity").cast("long") * 100).alias("duration_ms"))


_RUNS = _RUNS.replace("l_returnflag = 'R'", "l_quantity > 30")


@query("m3_job_outcomes", f"WITH {_RUNS} SELECT job, count(*) AS attempts, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CASE WHEN arg_max(status, (finished_at, attempt, status)) = 'completed' THEN 'completed' WHEN count(*) < 3 THEN 'retry' ELSE 'failed' END AS outcome FROM runs GROUP BY job")
def _(g):
    return jobs.job_outcomes(_runs(g))


def _triggers(g):
    rows = [("j1", "error", None, None), ("j2", "purchase", "web", None), ("j3", "click", "shop", "large"), ("j4", "nothing", None, None)]
    return g.spark.createDataFrame(rows, "id string, trigger_event string, trigger_source string, trigger_condition string")


CONDITIONS = {"large": lambda: F.col("value") > 50}


@query("m4_triggered_matches", "WITH e AS (SELECT 'Event/' || event_id AS event, event_type, value, CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'shop' END AS source FROM events) SELECT event, 'j1' AS job FROM e WHERE event_type = 'error' UNION ALL SELECT event, 'j2' FROM e WHERE event_type = 'purchase' AND source = 'web' UNION ALL SELECT event, 'j3' FROM e WHERE event_type = 'click' AND source = 'shop' AND value > 50")
def _(g):
    e = g.scan_class("Event").select("id", F.col("event_type").alias("kind"), "value", F.when(F.col("user_id") % 2 == 0, "web").otherwise("shop").alias("source"))
    return jobs.triggered_matches(e, _triggers(g), CONDITIONS)


@query("d12_job_stats", f"WITH {_JOBS} SELECT 'status' AS what, status AS value, count(*) AS n FROM jobs GROUP BY 2 UNION ALL SELECT 'queue', queue, count(*) FROM jobs WHERE status = 'pending' GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM jobs")
def _(g):
    return jobs.job_stats(_jobs(g))


@query("d13_execution_stats", f"WITH {_RUNS} SELECT status, count(*) AS n, round(avg(duration_ms), 4) AS avg_ms FROM runs WHERE finished_at >= TIMESTAMP '1995-01-01' GROUP BY status")
def _(g):
    return jobs.execution_stats(_runs(g), "1995-01-01 00:00:00").withColumn("avg_ms", F.round("avg_ms", 4))


# N: entitlements


def _grants(g):
    n, r = g.scan_class("Nation", ["in_region"]), g.scan_class("Region", ["r_name"])
    roles = n.select("id", F.array(F.concat(F.lit("read:"), "id")).alias("permissions"), F.array("in_region").alias("inherits_from")).union(r.select("id", F.array(F.concat(F.lit("list:"), "r_name")), F.array().cast("array<string>")))
    c = g.scan_class("Customer", ["in_nation", "mktsegment"])
    people = c.select("id", F.array("in_nation").alias("roles"), F.array("mktsegment").alias("groups"))
    groups = g.spark.createDataFrame([("BUILDING", ["Region/1"]), ("MACHINERY", ["Region/2"])], "id string, roles array<string>")
    return people, groups, roles


_N = "rp AS (SELECT 'Nation/' || n_nationkey AS role, 'read:Nation/' || n_nationkey AS permission FROM nation UNION SELECT 'Nation/' || n_nationkey, 'list:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'Region/' || r_regionkey, 'list:' || r_name FROM region), pr AS (SELECT 'Customer/' || c_custkey AS principal, 'Nation/' || c_nationkey AS role FROM customer UNION SELECT 'Customer/' || c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Region/1' ELSE 'Region/2' END FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), pp AS (SELECT DISTINCT principal, permission FROM pr JOIN rp USING (role))"


@query("n1_role_permissions", f"WITH {_N} SELECT * FROM rp")
def _(g):
    return access.role_permissions(_grants(g)[2])


@query("n2_principal_permissions", f"WITH {_N} SELECT * FROM pp")
def _(g):
    return access.principal_permissions(*_grants(g))


@query("n3_has_permission", f"WITH {_N} SELECT 'Customer/' || c_custkey AS principal, 'list:ASIA' AS permission FROM customer WHERE ('Customer/' || c_custkey, 'list:ASIA') IN (SELECT (principal, permission) FROM pp)")
def _(g):
    asked = g.scan_class("Customer", []).select(F.col("id").alias("principal"), F.lit("list:ASIA").alias("permission"))
    return access.has_permission(asked, access.principal_permissions(*_grants(g)))


# A7-A10: a Markdown corpus made of conversations


def _corpus(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("c"), (F.col("conv_id") % 10).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("rel_path")
    docs = c.select("conv_id", path).distinct().select("rel_path", F.create_map(F.lit("name"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))).alias("front"), F.lit("").alias("preamble"))
    secs = c.where("role is not null").select(path, F.col("turn").cast("int").alias("ord"), F.lit(2).alias("level"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("heading"), F.regexp_replace(F.coalesce("text", F.lit("")), "^\\n+|\\n+$", "").alias("body"), F.lit(None).cast("int").alias("parent"))
    return docs, secs


_MD = "c AS (SELECT 'c' || (conv_id % 10) || '/' || conv_id || '.md' AS rel_path, conv_id, CAST(turn AS INTEGER) AS ord, 'Turn ' || turn AS heading, text AS body FROM conversations)"


@query("a7_read_markdown_corpus", f"WITH {_MD} SELECT rel_path, ord, heading, body FROM c", graph=False)
def _(spark, sf_dir):
    from entigraph.scratch import new_path
    from entigraph.sources import markdown

    at = new_path(spark, "corpus")
    markdown.write_corpus_table(*_corpus(spark, sf_dir), at)
    return markdown.read_markdown_corpus(spark, at)[1].select("rel_path", "ord", "heading", "body")


@query("a8_write_markdown_corpus", f"WITH {_MD} SELECT rel_path, '---' || chr(10) || 'name: conversation ' || conv_id || chr(10) || '---' || chr(10) || chr(10) || string_agg('## ' || heading || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY ord) AS value FROM c GROUP BY rel_path, conv_id", graph=False)
def _(spark, sf_dir):
    from entigraph.sources import markdown

    return markdown.corpus_text(*_corpus(spark, sf_dir))


@query("a8_paths_by_function", f"WITH {_MD} SELECT DISTINCT 'all/' || conv_id || '.md' AS rel_path, regexp_extract(rel_path, '^c[0-9]') AS name FROM c", graph=False)
def _(spark, sf_dir):
    from entigraph.sources import markdown

    docs, secs = _corpus(spark, sf_dir)
    docs = docs.withColumn("front", F.create_map(F.lit("name"), F.regexp_extract("rel_path", "^c[0-9]", 0)))
    out = markdown.corpus_text(docs, secs, F.concat(F.lit("all/"), F.regexp_extract("rel_path", "[^/]*$", 0)))
    return out.select("rel_path", F.regexp_extract("value", "name: (c[0-9])", 1).alias("name"))


@query("a9_corpus_filter", f"WITH {_MD} SELECT rel_path, ord FROM c WHERE starts_with(rel_path, 'c3/') AND conv_id > 20", graph=False)
def _(spark, sf_dir):
    from entigraph.sources import markdown

    docs, secs = _corpus(spark, sf_dir)
    return markdown.corpus_filter(docs, secs, F.expr("cast(substring(front['name'], 14) as int) > 20"), "c3/")[1].select("rel_path", "ord")


@query("a10_corpus_roundtrip_check", "SELECT '' AS side, '' AS rel_path, 0 AS ord FROM conversations WHERE false", graph=False)
def _(spark, sf_dir):
    from entigraph.sources import markdown

    return markdown.corpus_roundtrip_check(*_corpus(spark, sf_dir))


# O: text expressions over whole texts


@query("o3_slugify", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''), ' ')), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents", graph=False)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", slugify(F.coalesce("text", F.lit(""))).alias("slug"))


@query("o6_normalize_body", "WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), '. ', '.  ' || chr(13) || chr(10) || chr(10) || chr(10)), ', ', ', ' || chr(9) || chr(10)), chr(10)) AS x FROM documents)), c AS (SELECT doc_id, i, rtrim(line, ' ' || chr(9) || chr(13)) AS bare, ends_with(rtrim(line, chr(13)), '  ') AND rtrim(line, ' ' || chr(9) || chr(13)) <> '' AS hard FROM l), n AS (SELECT *, CASE WHEN hard THEN bare || '  ' ELSE bare END AS line, lag(bare) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c), j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (bare <> '' OR before <> '') AS body FROM n GROUP BY doc_id), t AS (SELECT doc_id, rtrim(ltrim(coalesce(body, ''), chr(10)), chr(10) || ' ') AS body FROM j) SELECT doc_id, CASE body WHEN '' THEN '' ELSE body || chr(10) END AS body FROM t", graph=False)
def _(spark, sf_dir):
    """The texts with blank lines, hard breaks and trailing blanks put in."""
    rough = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".  \r\n\n\n")), F.lit(", "), F.lit(", \t\n"))
    return table(spark, sf_dir, "documents").select("doc_id", normalize_body(rough).alias("body"))


# S: streams, drained


def _stream(spark, sf_dir):
    e = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(spark, df, mode="append", **more):
    from entigraph.scratch import new_path
    from entigraph.streaming.jobs import drained

    return drained(df, new_path(spark, "stream"), mode, **more)


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("s1_stream_events", "SELECT 'Event/' || event_id AS id, ts AS timestamp, event_type AS kind FROM events", graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_events

    raw = _stream(spark, sf_dir).select(F.concat(F.lit("Event/"), F.col("event_id").cast("string")).alias("id"), F.lit("UserEvent").alias("class"), F.col("ts").cast("string").alias("timestamp"), F.concat(F.lit(":"), "event_type").alias("kind"), F.lit("a").alias("tags"), F.lit(None).cast("string").alias("correlation_id"))
    return _ntz(_drain(spark, stream_events(raw)).select("id", "timestamp", "kind"), "timestamp")


@query("s1_quarantine", "SELECT 'Event/' || event_id AS id, 'good' AS side, NULL AS reject FROM events WHERE event_id % 5 > 1 UNION ALL SELECT 'Event/' || event_id, 'bad', CASE event_id % 5 WHEN 0 THEN 'unknown-class' ELSE 'bad-correlation-id' END FROM events WHERE event_id % 5 <= 1", graph=False)
def _(spark, sf_dir):
    """Each event comes twice, two fifths of them bad."""
    from entigraph.scratch import new_path
    from entigraph.streaming.jobs import quarantined, stream_events

    at, k = new_path(spark, "stream"), F.col("event_id") % 5
    raw = _stream(spark, sf_dir).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    raw = raw.select(F.concat(F.lit("Event/"), F.col("event_id").cast("string")).alias("id"), F.when(k == 0, "Nothing").otherwise("UserEvent").alias("class"), F.col("ts").cast("string").alias("timestamp"), F.lit("x").alias("kind"), F.lit("a").alias("tags"), F.when(k == 1, "no uuid").alias("correlation_id"))
    quarantined(stream_events(raw), f"{at}/good", f"{at}/bad", f"{at}/checkpoint").awaitTermination()
    good = spark.read.schema("id string").parquet(f"{at}/good").select("id", F.lit("good").alias("side"), F.lit(None).cast("string").alias("reject"))
    return good.union(spark.read.schema("id string, reject string").parquet(f"{at}/bad").select("id", F.lit("bad"), "reject"))


@query("s2_stream_event_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL", graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_event_counts

    return _ntz(_drain(spark, stream_event_counts(_stream(spark, sf_dir), "1 day"), "complete").select("window_start", "event_type", "n"), "window_start")


def _two_batches(spark, sf_dir):
    """The events as files of a stream: those of the last days first, then all others, which are late where they lie behind the watermark. An empty one between
    them lets the watermark, which holds from the batch after the next, come to hold."""
    from entigraph.scratch import new_path

    at = new_path(spark, "late")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    edge = e.agg(F.max("ts")).first()[0]
    first = F.col("ts") > F.lit(edge) - F.expr("interval 3 days")
    for name, part in (("1", first), ("2", F.lit(False)), ("3", ~first)):
        e.where(part).coalesce(1).write.parquet(f"{at}/{name}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


@query("s2_late_rows", "WITH e AS (SELECT *, max(ts) OVER () AS edge FROM events), w AS (SELECT date_trunc('day', ts) AS window_start, event_type, edge, ts > edge - INTERVAL 3 DAY AS first FROM e) SELECT window_start, event_type, count(*) AS n FROM w WHERE first OR window_start + INTERVAL 1 DAY > edge - INTERVAL 10 DAY GROUP BY ALL", graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_event_counts

    out = _drain(spark, stream_event_counts(_two_batches(spark, sf_dir), "1 day", watermark="10 days"), "update", key=("window_start", "window_end", "event_type"))
    return _ntz(out.select("window_start", "event_type", "n"), "window_start")


@query("s2_sliding_counts", "SELECT ws AS window_start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) - INTERVAL 1 DAY * unnest([0, 1]) AS ws FROM events) GROUP BY ALL", graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_event_counts

    return _ntz(_drain(spark, stream_event_counts(_stream(spark, sf_dir), "2 days", "1 day"), "complete").select("window_start", "event_type", "n"), "window_start")


@query("s3_stream_correlations", "WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(CASE event_type WHEN 'error' THEN 2 ELSE 0 END) AS worst FROM s GROUP BY user_id, k", graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_correlations

    e = _stream(spark, sf_dir).withColumn("level", F.when(F.col("event_type") == "error", "error").otherwise("info"))
    return _ntz(_drain(spark, stream_correlations(e, "user_id", "1 day"), "complete"), "first_ts", "last_ts")


@query("s4_stream_workflow", ORACLE_SQL["l3_replay_transitions"], graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_workflow

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    g, user = demo.graph(spark, sf_dir), F.col("user_id")
    e = _stream(spark, sf_dir).select(F.concat(F.lit("p"), user.cast("string")).alias("process"), F.when(user % 2 == 0, "w").otherwise("v").alias("workflow"), "ts", F.col("event_type").alias("action"), F.col("event_id").cast("int").alias("seq"), "value", F.when(F.col("event_id") % 3 == 0, "why not").alias("reason"))
    out = _drain(spark, stream_workflow(e, _moves(g), _states(g), GUARDS))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("process").orderBy("ts", "seq"))
    return out.select("process", "workflow", place.cast("long").alias("seq"), "action", "from_state", "to_state", "accepted", "why")


@query("s5_stream_triggers", ORACLE_SQL["m4_triggered_matches"], graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_triggers

    g = demo.graph(spark, sf_dir)
    e = _stream(spark, sf_dir).select(F.concat(F.lit("Event/"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), "value", F.when(F.col("user_id") % 2 == 0, "web").otherwise("shop").alias("source"))
    return _drain(spark, stream_triggers(e, _triggers(g), CONDITIONS))


@query("s6_stream_validation", "SELECT 'Event/' || event_id AS id, 'invalid-type' AS error FROM events WHERE event_id % 9 = 0", graph=False)
def _(spark, sf_dir):
    from entigraph.scratch import new_path
    from entigraph.streaming.jobs import stream_validation

    at = new_path(spark, "stream")
    raw = _stream(spark, sf_dir).select(F.concat(F.lit("Event/"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("user_id"))
    stream_validation(raw, demo.registry(), "Event", f"{at}/good", f"{at}/bad", f"{at}/checkpoint").awaitTermination()
    bad = spark.read.schema("id string, user_id string, errors array<struct<slot:string,error:string>>, batch long").parquet(f"{at}/bad")
    return bad.select("id", F.explode("errors.error").alias("error"))


@query("s7_stream_subscriptions", "SELECT 's' || (user_id % 3) AS subscriber, 'u' || user_id AS id FROM events WHERE user_id % 3 <> 2", graph=False)
def _(spark, sf_dir):
    from entigraph.streaming.jobs import stream_subscriptions

    subs = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("k"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")).distinct().where("k <> 2").select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("subscriber"), "id")
    return _drain(spark, stream_subscriptions(_stream(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")), subs))
