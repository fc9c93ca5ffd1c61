"""Records of jobs and their executions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entigraph.operators.rules import Rule, holds, names_in

#: Conditions of triggered jobs by name: a Column over an event and a job; null is false. Calls may bring their own.
CONDITIONS: dict[str, Rule] = {}


def register_condition(name: str, rule: Rule) -> None:
    CONDITIONS[name] = rule


def jobs(table: DataFrame, status: Iterable[str] = ("pending", "running"), queue: str | None = None, tags: Iterable[str] = (), limit: int = 100) -> DataFrame:
    """By priority; tags: any of them."""
    out = table.where(F.col("status").isin(list(status)))
    out = out if queue is None else out.where(F.col("queue") == queue)
    if tags := list(tags):
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    out = out.orderBy(F.desc("priority"), "id")
    return out.limit(limit) if limit else out


def poll_queue(table: DataFrame, queue: str, limit: int = 10) -> DataFrame:
    return jobs(table, ("pending",), queue, limit=limit)


def due_jobs(table: DataFrame, now) -> DataFrame:
    """Pending ones whose run_at or next_run has come."""
    now = F.lit(now).cast("timestamp")
    return table.where((F.col("status") == "pending") & ((F.col("run_at") <= now) | (F.col("next_run") <= now)))


def job_outcomes(executions: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(job, attempts, duration_ms, outcome) from executions (job, status, finished_at, attempt, duration_ms): the last attempt decides."""
    last = F.max_by("status", F.struct("finished_at", "attempt", "status"))
    out = executions.groupBy("job").agg(F.count("*").alias("attempts"), F.sum("duration_ms").alias("duration_ms"), last.alias("last"))
    outcome = F.when(F.col("last") == "completed", "completed").when(F.col("attempts") < max_attempts, "retry").otherwise("failed")
    return out.select("job", "attempts", "duration_ms", outcome.alias("outcome"))


def triggered_matches(events: DataFrame, table: DataFrame, conditions: Mapping[str, Rule] | None = None) -> DataFrame:
    """(event, job): events (id, kind, source ...) that start jobs (id, trigger_event, trigger_source, trigger_condition). The events may be a stream."""
    e = events.withColumnRenamed("id", "event")
    j = table.withColumnRenamed("id", "job")
    both = e.join(j, e["kind"] == j["trigger_event"])
    met = holds(both, F.col("trigger_condition"), names_in(table, "trigger_condition"), CONDITIONS if conditions is None else conditions)
    return both.where((F.col("trigger_source").isNull() | (F.col("trigger_source") == F.col("source"))) & met).select("event", "job")


def job_stats(table: DataFrame) -> DataFrame:
    """(what, value, n): by status, pending ones by queue, and the total."""
    status = table.groupBy(F.lit("status").alias("what"), F.col("status").alias("value")).agg(F.count("*").alias("n"))
    queue = table.where("status = 'pending'").groupBy(F.lit("queue").alias("what"), F.col("queue").alias("value")).agg(F.count("*").alias("n"))
    return status.union(queue).union(table.select(F.lit("total").alias("what"), F.lit("").alias("value")).groupBy("what", "value").agg(F.count("*").alias("n")))


def execution_stats(executions: DataFrame, since=None) -> DataFrame:
    """(status, n, avg_ms)."""
    rows = executions if since is None else executions.where(F.col("started_at") >= F.lit(since).cast("timestamp"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("avg_ms"))
