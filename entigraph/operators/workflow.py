"""State machines over tables: definitions (states, transitions), processes and their histories. Each table has a column `workflow`, so that workflows may share names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.operators.navigate import graph_walk
from entigraph.operators.rules import Rule, holds, names_in, resolved
from entigraph.scratch import stored

KINDS = ("success", "failure", "cancel")
#: Guards by name: a Column over a process and a transition, or over a request in a replay; a null or failing guard is false. Calls may bring their own.
GUARDS: dict[str, Rule] = {}
#: A process with more than 2 to this power of requests is cut into stretches of so many, which are folded at once.
CHUNK_BITS = 12


def register_guard(name: str, rule: Rule) -> None:
    GUARDS[name] = rule


def check_workflows(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """(workflow, subject, violation) for states (workflow, state, terminal, terminal_kind) and transitions (workflow, name, from_state, to_state)."""
    kind = F.col("terminal_kind")
    rule = F.when(F.col("terminal") & kind.isNull(), "terminal-without-kind").when(~F.col("terminal") & kind.isNotNull(), "kind-without-terminal").when(kind.isNotNull() & ~kind.isin(*KINDS), "unknown-kind")
    out = states.select("workflow", F.col("state").alias("subject"), rule.alias("violation")).where("violation is not null")
    for end in ("from_state", "to_state"):
        lost = transitions.join(states.select("workflow", F.col("state").alias(end)), ["workflow", end], "left_anti")
        out = out.union(lost.select("workflow", F.col("name").alias("subject"), F.lit(f"unknown-{end.split('_')[0]}").alias("violation")))
    return out


def available_transitions(processes: DataFrame, transitions: DataFrame, guards: Mapping[str, Rule] | None = None) -> DataFrame:
    """processes with the transitions that leave their current state and whose guard holds."""
    both = processes.join(transitions.withColumnRenamed("from_state", "current_state"), ["workflow", "current_state"])
    return both.where(holds(both, F.col("guard"), names_in(transitions, "guard"), GUARDS if guards is None else guards))


def with_moves(log: DataFrame, transitions: DataFrame, guards: Mapping[str, Rule] | None = None) -> DataFrame:
    """log (workflow, action, reason, ...) with moves: from each state that the action leaves, its target, and why the request is refused there (null: it is not).

    What a request does depends on the state alone then: reasons and guards are looked at before states are known. Of several transitions from one state
    with one name the first by target counts. The log may be a stream."""
    guards, known = GUARDS if guards is None else guards, []
    for name in names_in(transitions, "guard"):
        if name in guards and (rule := resolved(log, guards[name])) is not None:
            known.append(F.when(rule, F.lit(name)))
    held = F.array_compact(F.array(*known)) if known else F.array().cast("array<string>")
    rules = transitions.groupBy("workflow", F.col("name").alias("action")).agg(F.sort_array(F.collect_list(F.struct("from_state", "to_state", "guard", "requires_reason"))).alias("rules"))
    asked = log.withColumns({"held": held, "given": F.coalesce(F.length("reason") > 0, F.lit(False))}).join(rules, ["workflow", "action"], "left")
    why = "case when coalesce(r.requires_reason, false) and not given then 'reason missing' when r.guard is not null and not array_contains(held, r.guard) then 'guard not met' end"
    moves = F.expr(f"transform(coalesce(rules, array()), r -> struct(r.from_state as from_state, r.to_state as to_state, {why} as why))")
    return asked.withColumn("moves", moves).drop("held", "given", "rules")


_STEP = "coalesce(get(transform(filter(s.moves, m -> m.from_state = {0} and m.why is null), m -> m.to_state), 0), {0})"


def _before(steps: DataFrame) -> DataFrame:
    """steps (process, start, pos, moves, request) with state, that before the step: the fold of a process's moves in order of pos.

    A step is a map of states, and so are many in a row: a process with more than 2 ** CHUNK_BITS steps is cut into stretches, each composed to one step by itself, and
    what holds before a stretch is found from these in the same way. No process comes to one task whole."""
    most = steps.groupBy("process").count().agg(F.max("count")).first()[0] or 0
    if most <= 1 << CHUNK_BITS:
        runs = steps.groupBy("process").agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "moves", "request"))).alias("steps"))
    else:
        steps = steps.withColumn("chunk", F.shiftright("pos", CHUNK_BITS))
        runs = steps.groupBy("process", "chunk").agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "moves", "request"))).alias("steps"))
        states = "array_distinct(flatten(transform(steps, s -> transform(s.moves, m -> m.from_state))))"
        whole = F.expr(f"transform({states}, d -> struct(d as from_state, aggregate(steps, d, (a, s) -> {_STEP.format('a')}) as to_state, cast(null as string) as why))")
        chunks = stored(runs.select("process", "start", F.col("chunk").alias("pos"), whole.alias("moves"), F.lit(None).cast("int").alias("request")), "workflow-chunks")
        entry = _before(chunks).select(F.col("process").alias("of"), F.col("pos").alias("at"), F.col("state").alias("start"))
        runs = runs.drop("start").join(entry, F.col("process").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at"))).drop("of", "at")  # a null process is one, too
    states = f"aggregate(steps, struct(start as state, cast(array() as array<string>) as out), (a, s) -> struct({_STEP.format('a.state')} as state, concat(a.out, array(a.state)) as out), a -> a.out)"
    each = runs.select("process", F.explode(F.arrays_zip("steps", F.expr(states).alias("states"))).alias("x"))
    return each.select("process", "x.steps.pos", "x.steps.moves", "x.steps.request", F.col("x.states").alias("state"))


def _starts(states: DataFrame | str) -> DataFrame | str:
    return states if isinstance(states, str) else states.where("initial").groupBy("workflow").agg(F.min("state").alias("start"))


def outcome(state: str, moves: str = "moves") -> list[Column]:
    """Of a request with moves (see with_moves) in a state: from_state, to_state, accepted, why."""
    m = f"get(filter({moves}, m -> m.from_state = {state}), 0)"
    ok = f"({m} is not null and {m}.why is null)"
    return [F.expr(x) for x in (f"{state} as from_state", f"if({ok}, {m}.to_state, {state}) as to_state", f"{ok} as accepted", f"if({m} is null, 'no such transition', {m}.why) as why")]


def replay_transitions(log: DataFrame, transitions: DataFrame, states: DataFrame | str, guards: Mapping[str, Rule] | None = None) -> DataFrame:
    """The fold of a log (process, workflow, ts, seq, action, reason, ...) into history rows (process, workflow, seq, action, from_state, to_state, ts, accepted, why).

    Each request is accepted from the state that the ones before led to, or refused: no such transition, reason missing, guard not met, in this order. Guards are
    Columns over the request. states: (workflow, state, initial), or the name of the state that all start in. A request is known by its ts and seq."""
    start = _starts(states)
    asked = with_moves(log, transitions, guards).drop("start")
    asked = asked.withColumn("start", F.lit(start)) if isinstance(start, str) else asked.join(start, "workflow", "left")
    ordered = asked.select("process", "start", "moves", F.struct("workflow", "seq", "action", "ts").alias("request")).repartitionByRange("process", "request.ts", "request.seq", "request.action")
    ordered = ordered.sortWithinPartitions("process", "request.ts", "request.seq", "request.action").withColumn("pos", F.monotonically_increasing_id())
    out = _before(stored(ordered, "workflow-requests"))  # stored: positions stay when a task is run again
    return out.select("process", "request.*", *outcome("state")).select("process", "workflow", "seq", "action", "from_state", "to_state", "ts", "accepted", "why")


def current_states(history: DataFrame, states: DataFrame) -> DataFrame:
    """(process, workflow, current_state, completed_at) from history: the last accepted row decides, or the workflow's initial state."""
    last = history.groupBy("process", "workflow").agg(F.max_by("to_state", F.when(F.col("accepted"), F.struct("ts", "seq"))).alias("s"), F.max(F.when(F.col("accepted"), F.col("ts"))).alias("at"))
    last = last.join(_starts(states), "workflow", "left").select("process", "workflow", F.coalesce("s", "start").alias("current_state"), "at")
    ends = states.select("workflow", F.col("state").alias("current_state"), "terminal")
    return last.join(ends, ["workflow", "current_state"], "left").select("process", "workflow", "current_state", F.when(F.col("terminal"), F.col("at")).alias("completed_at"))


def process_history(history: DataFrame, states: DataFrame) -> DataFrame:
    """Accepted steps with the labels of their states."""
    label = lambda end: states.select("workflow", F.col("state").alias(f"{end}_state"), F.col("label").alias(f"{end}_label"))
    out = history.where("accepted").join(label("from"), ["workflow", "from_state"], "left").join(label("to"), ["workflow", "to_state"], "left")
    return out.select("process", "workflow", "seq", "ts", "action", "from_label", "to_label")


def processes(table: DataFrame, active: bool | None = None, state: str | None = None, since=None, subject: str | None = None, limit: int = 100, of: str | None = None) -> DataFrame:
    """Newest first; table (id, workflow, current_state, started_at, completed_at, subject); of: a workflow."""
    if active is not None:
        table = table.where(F.col("completed_at").isNull() if active else F.col("completed_at").isNotNull())
    for c, v in (("workflow", of), ("current_state", state), ("subject", subject)):
        table = table if v is None else table.where(F.col(c) == v)
    table = table if since is None else table.where(F.col("completed_at") >= F.lit(since).cast("timestamp"))
    table = table.orderBy(F.desc("started_at"), "id")
    return table.limit(limit) if limit else table


def outcome_status(asked: DataFrame, table: DataFrame, states: DataFrame) -> DataFrame:
    """(id, status): missing, running, completed, failed or cancelled."""
    known = asked.select("id").join(table.select("id", "workflow", F.col("current_state").alias("state")), "id", "left").join(states.select("workflow", "state", "terminal", "terminal_kind"), ["workflow", "state"], "left")
    kind = F.col("terminal_kind")
    status = F.when(F.col("state").isNull(), "missing").when(~F.coalesce("terminal", F.lit(False)), "running").when(kind == "failure", "failed").when(kind == "cancel", "cancelled").otherwise("completed")
    return known.select("id", status.alias("status"))


def cancellable(table: DataFrame, transitions: DataFrame, states: DataFrame, guards: Mapping[str, Rule] | None = None) -> DataFrame:
    """(id) of processes with an available transition into a state of kind cancel."""
    to = states.where("terminal_kind = 'cancel'").select("workflow", F.col("state").alias("to_state"))
    return available_transitions(table, transitions, guards).join(to, ["workflow", "to_state"], "left_semi").select("id").distinct()


def workflow_reachability(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """states (workflow, state, initial, terminal) with reachable, and dead_end: not terminal and without a transition."""
    name = lambda s: F.concat_ws("\u0001", "workflow", s)
    edges = transitions.select(name("from_state").alias("src"), F.lit("t").alias("predicate"), name("to_state").alias("dst"))
    start = states.where("initial").select(name("state").alias("id"))
    reached = graph_walk(start, edges, None).select(F.col("node").alias("id")).union(start).distinct().withColumn("reachable", F.lit(True))
    out = states.withColumn("id", name("state")).join(reached, "id", "left")
    leaves = edges.select(F.col("src").alias("id")).distinct().withColumn("leaves", F.lit(True))
    out = out.join(leaves, "id", "left")
    return out.select("workflow", "state", "terminal", F.coalesce("reachable", F.lit(False)).alias("reachable"), (~F.col("terminal") & F.col("leaves").isNull()).alias("dead_end"))


def workflow_stats(table: DataFrame) -> DataFrame:
    """(state, n, n_completed, n_active); the row without a state is the total."""
    return table.rollup(F.col("current_state").alias("state")).agg(F.count("*").alias("n"), F.count("completed_at").alias("n_completed"), F.sum(F.when(F.col("completed_at").isNull(), 1).otherwise(0)).alias("n_active"))
