r"""Benchmark decontamination by a positional inverted index.

The index is written once: of the training texts' words those that the benchmark has too, each a posting (term, document, position), in segments, a file
a task, each in order of term. Segments are cut by document, so that no term, however frequent, is one task's work; counts, lists and the verification
read them, and texts are not cut into words again for these.

A benchmark item is cut into windows of 13 words; an item of fewer words is one window. A window is matched where at least NEAR of its words stand in
their places: an exact phrase if all do, else a proximity match. Of each window the rarest terms are looked up, two more than may be out of place. Their
lists, each moved by the term's place in the item, are intersected: two terms at least must put the item at the same offset of the same document, which
holds for every match, exact or near, so none is missed. Of what survives all words of the window are looked up at their positions.

DataFrame functions throughout. Items, terms and counts are joined by Spark's choice, from their true sizes.

Defined cases: null and wordless texts have no words and no hits; an item without words has no window; rows with the same doc_id and another text are
told apart; repeated rows get the same result; a null item_id is listed as the empty string; the caller's columns stay, but for those that contaminated()
adds; with an empty benchmark nothing is hit; words that a proximity match puts before a text's start or behind its end are out of place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import LOWER, UPPER, ascii_lower, row_key, stored, table, unused

#: Fixed values of the contamination rule.
WORD, BETWEEN, WINDOW, ONE_IN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", 13, 20
#: Part of a window's words that must be in their places for a proximity match.
NEAR = 0.8
_NO_ID = -(2**63)


def words(text: Column) -> Column:
    """Runs of WORD in the lower-cased text. Cut at what is between them: regexp_extract_all() takes ten times as long, as it copies the text for each match."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def _keys(docs: DataFrame, d: str = "d", th: str = "th") -> dict[str, Column]:
    """Two columns that tell rows apart."""
    return {d: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: row_key(F.col("text").cast("string"))}


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (tid, d, th, pos) for each word of docs that is among terms (tid, term); d and th tell rows apart. Stored in segments, each in order of tid."""
    keys = _keys(docs)
    each = docs.select(*[c.alias(n) for n, c in keys.items()], F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return stored(each.join(terms, "term").select("tid", "d", "th", "pos").sortWithinPartitions("tid"), "decontamination-postings")


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """(ik, item_id, w, size): numbered items with words, and the size of their windows."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    return stored(rows.select(F.monotonically_increasing_id().alias("ik"), "item_id", "w", F.least(F.size("w"), F.lit(window)).alias("size")), "decontamination-items")


def _plans(items: DataFrame, places: DataFrame, counts: DataFrame, near: float) -> DataFrame:
    """(ik, windows): of each window its start, the places in the item of the terms to look up, and how many of these must be found at one offset.

    free: how many words may be out of place; a term that no document has is. A window with more such terms than that cannot be matched and is left out."""
    by_place = F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"))))
    ranked = places.join(counts, "tid", "left").groupBy("ik").agg(by_place.alias("p")).join(items.select("ik", "size"), "ik")
    windows = f"""transform(sequence(0, size(p) - size), s -> struct(s as start, array_sort(transform(filter(slice(p, s + 1, size), x -> x.n > 0), x -> struct(x.n as n, x.at as at))) as rare,
        size - cast(ceil({float(near)} * size) as int) - size(filter(slice(p, s + 1, size), x -> x.n = 0)) as free))"""
    kept = f"transform(filter({windows}, x -> x.free >= 0 and size(x.rare) > 0), x -> struct(x.start as start, transform(slice(x.rare, 1, x.free + 2), r -> r.at) as ats, least(size(x.rare), x.free + 2) - x.free as need))"
    return ranked.select("ik", F.expr(kept).alias("windows")).where(F.size("windows") > 0)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """(d, th, item_id, offset, hits): for each document (d, th: see postings) and each offset of an item in it, where that has hits, the array of (start,
    size, matched), one for each matched window: matched = size is an exact phrase, less a proximity match. start is the window's first word in the document, from 0."""
    items = _items(benchmark, window)
    terms = stored(items.select(F.explode("w").alias("term")).distinct().select(F.monotonically_increasing_id().alias("tid"), "term"), "decontamination-terms")
    places = stored(items.select("ik", F.posexplode("w").alias("at", "term")).join(terms, "term").select("ik", "at", "tid"), "decontamination-places")
    index = postings(docs, terms)
    counts = stored(index.groupBy("tid").agg(F.count("*").alias("n")), "decontamination-counts")
    plans = stored(_plans(items, places, counts, near), "decontamination-plans")
    rare = plans.select("ik", F.array_min(F.transform("windows", lambda x: x["need"])).alias("need"), F.explode(F.expr("array_distinct(flatten(transform(windows, x -> x.ats)))")).alias("at"))
    sizes = items.select("ik", "item_id", "size", F.size("w").alias("length"))
    rare = stored(rare.join(places, ["ik", "at"]).join(sizes.select("ik", "size"), "ik"), "decontamination-lookups")
    # of each document and offset only how many looked-up terms stand there, and between which: two apart by a window or more are not in one
    lists = index.join(rare, "tid").select("d", "th", "ik", (F.col("pos") - F.col("at")).alias("offset"), "at", "need", "size")
    placed = lists.groupBy("d", "th", "ik", "offset").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("need").alias("need"), F.min("size").alias("size"))
    candidates = stored(placed.where("n >= need and (need = 1 or n > 2 or lo < hi and hi - lo < size)").select("d", "th", "ik", "offset", "lo", "hi"), "decontamination-candidates")
    span = candidates.join(sizes, "ik").select("d", "th", "ik", "offset", F.expr("explode(sequence(greatest(lo - size + 1, 0), least(hi + size, length) - 1)) as at"))
    needed = span.join(places, ["ik", "at"]).withColumn("pos", F.col("offset") + F.col("at"))
    near_by = index.join(stored(candidates.select("d", "th").distinct(), "decontamination-near"), ["d", "th"], "left_semi")
    there = needed.join(near_by, ["d", "th", "tid", "pos"], "left_semi").groupBy("d", "th", "ik", "offset").agg(F.collect_set("at").alias("there"))
    starts = "sequence(greatest(array_min(there) - size + 1, 0), least(array_max(there), length - size))"
    hits = f"filter(transform({starts}, s -> struct(offset + s as start, size as size, size(filter(there, a -> a >= s and a < s + size)) as matched)), h -> h.matched >= {float(near)} * h.size)"
    found = there.join(sizes, "ik").select("d", "th", "item_id", "offset", F.expr(hits).alias("hits"))
    return stored(found.where(F.size("hits") > 0), "decontamination-matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """docs with n_words, n_hit, items (sorted as strings), contaminated, and near_items: items with proximity matches only; columns of docs that have these names are left out."""
    docs = docs.drop("n_words", "n_hit", "items", "contaminated", "near_items")
    found = matches(docs, benchmark, window, near)
    exact = found.select("d", "th", "item_id", F.expr("filter(hits, h -> h.matched = h.size)").alias("hits"))
    covered = exact.select("d", "th", F.explode(F.expr("array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.size - 1))))")).alias("pos")).distinct()
    n_hit = covered.groupBy("d", "th").agg(F.count("*").alias("n_hit"))
    by_item = exact.groupBy("d", "th", "item_id").agg(F.max(F.size("hits") > 0).alias("exact"))
    listed = by_item.groupBy("d", "th").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.array_sort(F.collect_list(F.when(~F.col("exact"), F.col("item_id")))).alias("near_items"))
    d, th = unused(docs, "d"), unused(docs, "th")
    marks = stored(listed.join(n_hit, ["d", "th"], "left").withColumnsRenamed({"d": d, "th": th}), "decontamination-marks")
    out = docs.withColumns(_keys(docs, d, th)).withColumn("n_words", F.size(words(F.col("text"))).cast("long")).join(marks, [d, th], "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "near_items": F.coalesce("near_items", none)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).drop(d, th)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.array_join("near_items", ",").alias("near_items"))


def hits_sql(documents: str = "documents") -> str:
    """WITH clauses (DuckDB) d (rid, doc_id, w), hit (rid, i, m, item_id) and pos (rid, p) over a table of documents."""
    cut = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, {cut} AS w FROM {documents}),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, w, least({WINDOW}, len(w)) AS m FROM (SELECT item_id, {cut} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
dg AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
hit AS (SELECT DISTINCT rid, i, m, item_id FROM dg JOIN bw USING (m, g)),
pos AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit)),
per AS (
  SELECT d.rid, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
  FROM d LEFT JOIN (SELECT rid, count(*) AS n_hit FROM pos GROUP BY rid) USING (rid)
  LEFT JOIN (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid) USING (rid)
)"""


OP8_SQL = f"""
WITH {hits_sql()},
bt AS (SELECT bk, item_id, m, len(w) AS n, unnest(range(len(w))) AS k, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS bk FROM b)),
dt AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS term FROM d),
offs AS (SELECT rid, bk, item_id, m, n, pos - k AS o, list(k) AS ats FROM dt JOIN bt USING (term) GROUP BY ALL HAVING count(*) >= {NEAR} * m),
near AS (SELECT DISTINCT rid, item_id FROM (SELECT *, unnest(range(n - m + 1)) AS s FROM offs) WHERE len(list_filter(ats, lambda a: a >= s AND a < s + m)) >= {NEAR} * m),
nearly AS (SELECT rid, string_agg(item_id, ',' ORDER BY item_id) AS near_items FROM (SELECT * FROM near EXCEPT SELECT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AND {ONE_IN} * n_hit >= n_words AS contaminated, coalesce(near_items, '') AS near_items FROM per LEFT JOIN nearly USING (rid)
"""
