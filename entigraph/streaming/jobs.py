"""Structured Streaming forms of the event, workflow, validation and job operators."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from entigraph.model import TypeRegistry
from entigraph.operators.events import normalize_events
from entigraph.operators.jobs import triggered_matches
from entigraph.operators.rules import Rule
from entigraph.operators.workflow import with_moves
from entigraph.sources.entities import split_valid


def stream_events(stream: DataFrame, key: str = "id", watermark: str = "1 hour") -> DataFrame:
    """Coerced events, each key once within the watermark; `reject` tells rows for a quarantine sink (see quarantined)."""
    typed = normalize_events(stream, F.current_timestamp())
    return typed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark([key])


def quarantined(events: DataFrame, good_path: str, reject_path: str, checkpoint: str):
    """Starts a query that writes each batch's events without a `reject` to one folder and the others to another; the batch number tells repeats apart."""

    def batch(df: DataFrame, number: int) -> None:
        df.where("reject is null").drop("reject").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        df.where("reject is not null").write.mode("overwrite").parquet(f"{reject_path}/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_event_counts(stream: DataFrame, window: str, slide: str | None = None, by: tuple[str, ...] = ("event_type",), ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """(window_start, window_end, by..., n) in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    n = stream.withWatermark(ts, watermark).groupBy(w, *by).agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def stream_correlations(stream: DataFrame, key: str, gap: str, ts: str = "ts", level: str = "level", watermark: str = "1 day") -> DataFrame:
    """A session of each key: first and last event, count, and whether the worst level is error."""
    s = stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), key)
    out = s.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.max(F.when(F.col(level) == "error", 2).when(F.col(level) == "warn", 1).otherwise(0)).alias("worst"))
    return out.select(key, "first_ts", "last_ts", "n", "worst")


class _Machine(StatefulProcessor):
    """Keeps each process's state; what a request does in it comes with the request (see with_moves)."""

    def __init__(self, terminal: set[tuple[str, str]], idle_ms: int) -> None:
        self.terminal, self.idle_ms = terminal, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, workflow string, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts", "seq", "action"], kind="stable")
        (state, _, last), out = self.state.get() if self.state.exists() else (rows.start.iloc[0], None, 0), []
        for r in rows.itertuples():
            move = next((m for m in r.moves if m["from_state"] == state), None)
            why = "no such transition" if move is None else move["why"]
            to = move["to_state"] if why is None else state
            out.append((key[0], r.workflow, r.seq, r.action, state, to, r.ts, why is None, why, why is None and (r.workflow, to) in self.terminal))
            state, last = to, max(last, int(r.ts.timestamp() * 1000))
        self.state.update((state, r.workflow, last))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state, workflow, last = self.state.get()
            self.state.clear()
            yield pd.DataFrame([(key[0], workflow, None, None, state, state, pd.Timestamp(last, unit="ms"), False, "idle", False)], columns=_COLUMNS).astype({"seq": "Int32"})

    def close(self) -> None:
        pass


_HISTORY = "process string, workflow string, seq int, action string, from_state string, to_state string, ts timestamp, accepted boolean, why string, completes boolean"
_COLUMNS = [c.split()[0] for c in _HISTORY.split(", ")]
#: Terminal states of all workflows, at most.
MAX_STATES = 10_000


def stream_workflow(stream: DataFrame, transitions: DataFrame, states: DataFrame, guards: Mapping[str, Rule] | None = None, idle_ms: int = 0, watermark: str = "1 day") -> DataFrame:
    """History rows of requests (process, workflow, ts, action, seq, reason, ...) as they come, with `completes` where a terminal state is reached; the state of each
    process is kept (RocksDB state store needed).

    idle_ms: a process without a request for so long in event time, behind the watermark, gives a row with why = idle and is forgotten; a later request starts anew."""
    rows = states.where("terminal").select("workflow", "state").limit(MAX_STATES + 1).collect()
    if len(rows) > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} terminal states")
    asked = with_moves(stream.withWatermark("ts", watermark) if idle_ms else stream, transitions, guards).drop("start")
    asked = asked.join(states.where("initial").groupBy("workflow").agg(F.min("state").alias("start")), "workflow", "left")
    machine = _Machine({(r.workflow, r.state) for r in rows}, idle_ms)
    return asked.select("process", "workflow", "seq", "ts", "action", "start", "moves").groupBy("process").transformWithStateInPandas(machine, _HISTORY, "Append", "EventTime" if idle_ms else "None")


def stream_triggers(stream: DataFrame, jobs: DataFrame, conditions: Mapping[str, Rule] | None = None) -> DataFrame:
    """(event, job) as events come, against a static table of jobs."""
    return triggered_matches(stream, jobs, conditions)


def stream_validation(stream: DataFrame, registry: TypeRegistry, name: str, good_path: str, reject_path: str, checkpoint: str):
    """Starts a query that appends each batch's good rows and its rejects with their errors; the batch number tells repeats apart."""

    def batch(df: DataFrame, number: int) -> None:
        good, bad = split_valid(df, registry, name)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{reject_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_subscriptions(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, id): a notice for each subscriber of each changed entity; subscriptions (subscriber, id) are static."""
    return changes.select("id").join(subscriptions, "id").select("subscriber", "id")


def drained(df: DataFrame, path: str, mode: str = "append", key: tuple[str, ...] = ()) -> DataFrame:
    """Runs a streaming frame over all that is there and returns what it gave, from the tables of a sink at path: of complete mode the last batch, of update mode,
    which needs the key, the last row of each key, of append mode all."""
    if mode == "update" and not key:
        raise ValueError("update mode tells rows by a key")
    spark = df.sparkSession
    schema = df.schema

    def put(b: DataFrame, number: int) -> None:
        b.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("batch"))
        out = out.join(last, "batch", "left_semi")
    if mode == "update":
        last = out.groupBy(*key).agg(F.max_by(F.struct(*[c for c in out.columns if c not in key]), "batch").alias("last"))
        out = last.select(*key, "last.*").select(*out.columns)
    return out.drop("batch")
