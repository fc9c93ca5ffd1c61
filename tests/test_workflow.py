"""Guards, several workflows, long processes and idle ones."""

import random

import pytest
from pyspark.sql import functions as F

from entigraph.operators import jobs, workflow
from entigraph.streaming.jobs import drained, stream_workflow

LOG = "process string, workflow string, t int, seq int, action string, reason string, money int"
MOVES = "workflow string, name string, from_state string, to_state string, guard string, requires_reason boolean"
STATES = "workflow string, state string, label string, initial boolean, terminal boolean, terminal_kind string"
RICH = {"rich": lambda: F.col("money") > 10, "elsewhere": lambda: F.col("no_such_column") > 0}


def fold(log, moves, initial):
    """The brute-force version, over tuples."""
    out, state = {}, {}
    for p, w, t, seq, action, reason, money in sorted(log, key=lambda r: (r[0], r[2], r[3], r[4])):
        now = state.get(p, initial[w])
        hit = min((m for m in moves if m[:3] == (w, action, now)), key=lambda m: m[3], default=None)
        why = "no such transition" if hit is None else "reason missing" if hit[5] and not reason else "guard not met" if hit[4] and not (hit[4] == "rich" and (money or 0) > 10) else None
        out[p, t, seq, action] = (w, now, hit[3] if why is None else now, why is None, why)
        state[p] = hit[3] if why is None else now
    return out


def random_log(r, n, processes=6):
    """One process has a third of all rows."""
    return [(p := r.choice(["p0", *[f"p{i}" for i in range(processes)]]), "wv"[int(p[1]) % 2], r.randrange(n), i, r.choice("abc"), r.choice([None, "", "why"]), r.choice([None, 5, 50])) for i in range(n)]


def moves_of(r):
    return [(w, n, s, r.choice("xyz"), r.choice([None, None, "rich", "unknown", "elsewhere"]), r.random() < 0.3) for w in "wv" for n in "abc" for s in "xyz" if r.random() < 0.8]


@pytest.mark.parametrize("bits", [1, 2, 5, 12])
def test_replay_against_brute_force(spark, monkeypatch, bits):
    """Cut into stretches of 2, 4, 32 requests, in several levels, or not at all."""
    monkeypatch.setattr(workflow, "CHUNK_BITS", bits)
    r = random.Random(bits)
    log, moves = random_log(r, 90), moves_of(r)
    states = spark.createDataFrame([(w, s, s, s == "xy"["wv".index(w)], False, None) for w in "wv" for s in "xyz"], STATES)
    df = spark.createDataFrame(log, LOG).withColumn("ts", F.timestamp_seconds("t"))
    got = workflow.replay_transitions(df, spark.createDataFrame(moves, MOVES), states, RICH).withColumn("t", F.unix_seconds("ts").cast("int")).collect()
    assert {(x.process, x.t, x.seq, x.action): (x.workflow, x.from_state, x.to_state, x.accepted, x.why) for x in got} == fold(log, moves, {"w": "x", "v": "y"})
    assert len(got) == len(log)


def test_guards_look_at_what_a_table_names(spark):
    """An unknown guard and one that asks for a column that is not there are false; guards that no transition names do no harm."""
    p = spark.createDataFrame([("1", "w", "s", 5), ("2", "w", "s", 50), ("3", "w", "s", None), ("4", "v", "s", 50)], "id string, workflow string, current_state string, money int")
    t = spark.createDataFrame([("w", "go", "s", "t", "rich", False), ("w", "stay", "s", "s", None, False), ("w", "x", "s", "t", "unknown", False), ("w", "y", "s", "t", "elsewhere", False)], MOVES)
    got = lambda p, t, **more: sorted((r.id, r.name) for r in workflow.available_transitions(p, t, **more).collect())
    assert got(p, t, guards=RICH) == [("1", "stay"), ("2", "go"), ("2", "stay"), ("3", "stay")]
    assert got(p.drop("money"), t.where("guard is null"), guards=RICH) == [("1", "stay"), ("2", "stay"), ("3", "stay")]
    assert got(p.drop("money"), t, guards=RICH) == [("1", "stay"), ("2", "stay"), ("3", "stay")]
    workflow.register_guard("rich", RICH["rich"])
    try:
        assert ("2", "go") in got(p, t)
    finally:
        workflow.GUARDS.clear()


def test_conditions_look_at_what_a_table_names(spark):
    e = spark.createDataFrame([("e", "k", "web")], "id string, kind string, source string")
    j = lambda c: spark.createDataFrame([("j", "k", None, c)], "id string, trigger_event string, trigger_source string, trigger_condition string")
    rules = {"big": lambda: F.col("value") > 1, "yes": lambda: F.col("source") == "web"}
    assert [jobs.triggered_matches(e, j(c), rules).count() for c in (None, "yes", "big", "unknown")] == [1, 1, 0, 0]


def test_workflows_that_share_names(spark):
    states = spark.createDataFrame([("w", "new", "New", True, False, None), ("w", "end", "End", False, True, "success"), ("v", "new", "Neu", False, False, None), ("v", "start", "Anfang", True, False, None)], STATES)
    moves = spark.createDataFrame([("w", "go", "new", "end", None, False), ("v", "go", "start", "new", None, True)], MOVES)
    log = spark.createDataFrame([("p", "w", 1, 1, "go", None, 0), ("q", "v", 1, 1, "go", None, 0), ("q", "v", 2, 2, "go", "why", 0), ("r", "v", 1, 1, "no", None, 0)], LOG).withColumn("ts", F.timestamp_seconds("t"))
    h = workflow.replay_transitions(log, moves, states)
    assert sorted((r.process, r.from_label, r.to_label) for r in workflow.process_history(h, states).collect()) == [("p", "New", "End"), ("q", "Anfang", "Neu")]
    now = {r.process: (r.current_state, r.completed_at is not None) for r in workflow.current_states(h, states).collect()}
    assert now == {"p": ("end", True), "q": ("new", False), "r": ("start", False)}
    assert workflow.replay_transitions(log.limit(0), moves, states).count() == 0


def test_stream_is_the_replay_and_forgets_idle_processes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    states = spark.createDataFrame([("w", "x", "X", True, False, None), ("w", "y", "Y", False, True, "success")], STATES)
    moves = spark.createDataFrame([("w", "a", "x", "y", "rich", False)], MOVES)
    day = 86_400
    batches = [[("p", "w", 0, 1, "a", None, 50), ("q", "w", 0, 1, "a", None, 5)], [("r", "w", 9 * day, 1, "a", None, 50)], [("s", "w", 9 * day, 1, "b", None, 50)], [("p", "w", 9 * day, 2, "a", None, 5), ("q", "w", 9 * day, 2, "a", None, 50)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000_000)).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"file://{tmp_path}/in/0").schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    rows = lambda df: sorted(((r.process, r.seq or 0, r.from_state, r.to_state, r.why or "", r.completes) for r in df.collect()))
    plain = drained(stream_workflow(stream(), moves, states, RICH), f"file://{tmp_path}/a")
    assert rows(plain) == [("p", 1, "x", "y", "", True), ("p", 2, "y", "y", "no such transition", False), ("q", 1, "x", "x", "guard not met", False), ("q", 2, "x", "y", "", True), ("r", 1, "x", "y", "", True), ("s", 1, "x", "x", "no such transition", False)]
    idle = rows(drained(stream_workflow(stream(), moves, states, RICH, idle_ms=3 * day * 1000, watermark="1 day"), f"file://{tmp_path}/b"))
    assert ("p", 0, "y", "y", "idle", False) in idle and ("p", 2, "x", "x", "guard not met", False) in idle  # p began anew


@pytest.mark.parametrize("bits", [1, 12])
def test_a_null_process_stays_however_long_another_is(spark, monkeypatch, bits):
    monkeypatch.setattr(workflow, "CHUNK_BITS", bits)
    log = [("p", "w", t, t, "a", None, None) for t in range(6)] + [(None, "w", t, t, "a", None, None) for t in range(5)]
    moves = spark.createDataFrame([("w", "a", "x", "y", None, False), ("w", "a", "y", "z", None, False)], MOVES)
    got = workflow.replay_transitions(spark.createDataFrame(log, LOG).withColumn("ts", F.timestamp_seconds("t")), moves, "x").collect()
    assert len(got) == 11
    assert {r.seq: (r.from_state, r.to_state) for r in got if r.process is None} == {0: ("x", "y"), 1: ("y", "z"), 2: ("z", "z"), 3: ("z", "z"), 4: ("z", "z")}
