"""Event logs: coercion, listings, correlations, HTTP requests and event trees."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.functions.text import is_uuid, keyword, millis_between
from entigraph.operators.navigate import graph_walk

CLASSES = ("Event", "ServerEvent", "UserEvent", "SystemEvent", "HttpEvent", "ApiEvent", "TransactionEvent")


def normalize_events(raw: DataFrame, now: Column, classes: Iterable[str] = CLASSES) -> DataFrame:
    """raw (id, class, timestamp, kind, tags, correlation_id ...) as strings: typed, tags a set, a missing timestamp is now, and `reject` tells what is wrong."""
    ts = F.col("timestamp").try_cast("timestamp")
    reject = F.when(~F.col("class").isin(list(classes)) | F.col("class").isNull(), "unknown-class").when(F.col("timestamp").isNotNull() & ts.isNull(), "bad-timestamp")
    out = raw.withColumn("reject", reject.when(F.col("correlation_id").isNotNull() & ~is_uuid(F.col("correlation_id")), "bad-correlation-id"))
    return out.withColumns({"timestamp": F.coalesce(ts, now), "kind": keyword(F.col("kind")), "tags": F.array_sort(F.array_distinct(F.filter(F.split("tags", r"\s*,\s*"), lambda t: t != "")))})


def list_events(events: DataFrame, kind: str | None = None, level: str | None = None, status: str | None = None, since=None, until=None, limit: int = 100) -> DataFrame:
    """Newest first, since <= ts < until."""
    for c, v in (("kind", kind), ("level", level), ("status", status)):
        events = events if v is None else events.where(F.col(c) == v)
    events = events if since is None else events.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    events = events if until is None else events.where(F.col("ts") < F.lit(until).cast("timestamp"))
    events = events.orderBy(F.desc("ts"), "id")
    return events.limit(limit) if limit else events


def events_by_correlation(events: DataFrame, correlation) -> DataFrame:
    return events.where(F.col("correlation_id") == correlation).orderBy("ts", "id")


def correlations(events: DataFrame) -> DataFrame:
    """(correlation_id, n, first_ts, last_ts, n_errors): a summary of each, combined before it is shuffled."""
    return events.groupBy("correlation_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.when(F.col("level") == "error", 1).otherwise(0)).alias("n_errors"))


def http_events(requests: DataFrame) -> DataFrame:
    """requests (status_code, started, finished ...) with level and duration in ms."""
    s = F.col("status_code")
    level = F.when(s.isNull(), "error").when(s < 400, "info").when(s < 500, "warn").otherwise("error")
    return requests.withColumns({"level": level, "duration": millis_between(F.col("started"), F.col("finished"))})


def notable_requests(requests: DataFrame, own_paths: Iterable[str] = ("/api/event",), slow_ms: int = 1000) -> DataFrame:
    """Requests that failed (5xx) or were slow, tagged; the event log's own are left out."""
    failed, slow = F.col("status_code") >= 500, F.col("duration") > slow_ms
    for p in own_paths:
        requests = requests.where(~F.col("path").startswith(p))
    return requests.where(failed | slow).withColumn("tags", F.array_compact(F.array(F.when(failed, "error"), F.when(slow, "slow"))))


def event_tree(roots: DataFrame, events: DataFrame) -> DataFrame:
    """(seed, node, hop): all events below the roots (id) by their parent reference."""
    edges = events.where("parent is not null").select(F.col("id").alias("src"), F.lit("parent").alias("predicate"), F.col("parent").alias("dst"))
    return graph_walk(roots, edges, None, "inverse")
