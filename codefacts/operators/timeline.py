"""Task history: timelines, tool pairing, state replay, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.functions import fixed
from codefacts.functions.records import role_for, structured_payload
from codefacts.operators.scan import fifo_positions, minute_bucket, row_numbers, running_sum, seq_bucket

TASK = ["project_id", "task_id"]
ENTRY = [*TASK, "ts", "key", "kind", "sender", "content", "structured"]


def pair_tool_events(events: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Tool calls: every ToolFinished takes the oldest pending ToolStarted of its task, by ``seq``.

    A finish with nothing pending and a start that never finishes are dropped; the finish's payload keys override
    the start's.
    """
    rows = events.where(F.col("type").isin("ToolStarted", "ToolFinished"))
    placed = fifo_positions(rows, TASK, seq_bucket("seq", block), ["seq"], F.col("type") == "ToolStarted", F.col("type") == "ToolFinished")
    start = placed.where("type = 'ToolStarted'").select(*TASK, "slot", F.col("seq").alias("start_seq"), F.col("ts").alias("start_ts"), F.col("payload").alias("start_payload"))
    end = placed.where("type = 'ToolFinished' and slot is not null").select(*TASK, "slot", F.col("seq").alias("end_seq"), F.col("ts").alias("end_ts"), F.col("payload").alias("end_payload"))
    return start.join(end, [*TASK, "slot"])


def merged_payload(start: Column, end: Column) -> Column:
    """Top-level keys of two JSON objects; the second wins."""
    a = F.coalesce(F.from_json(start, "map<string,string>"), F.create_map().cast("map<string,string>"))
    b = F.coalesce(F.from_json(end, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def build_timeline(
    messages: DataFrame | None = None, decisions: DataFrame | None = None, evidence: DataFrame | None = None,
    changes: DataFrame | None = None, events: DataFrame | None = None, block: int = 1_000_000, system: str = "system",
) -> DataFrame:
    """All facts of a task in one order (time, then key); ``seq`` counts from 0 per task.

    Positions come from minute buckets, so a task of any length is numbered in parallel.
    """
    none = F.lit(None).cast("string")
    parts = []

    def part(df: DataFrame, ts: str, key: Column, kind: str, sender: Column, content: Column, structured: Column) -> None:
        parts.append(df.select(*TASK, F.col(ts).alias("ts"), key.alias("key"), F.lit(kind).alias("kind"), sender.alias("sender"),
                               content.alias("content"), structured.alias("structured")))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if messages is not None:
        part(messages, "created_at", F.concat(F.lit("m:"), text("id")), "message", F.col("sender"), text("content"), structured_payload("content"))
    if decisions is not None:
        part(decisions, "created_at", F.concat(F.lit("d:"), text("id")), "decision", F.lit(system), text("reason"), F.lit("decision"))
    if evidence is not None:
        part(evidence, "timestamp", F.concat(F.lit("e:"), text("id")), "evidence", F.lit(system), F.concat(text("command"), F.lit(" exit="), F.coalesce(F.col("exit_code").cast("string"), F.lit("None"))), none)
    if changes is not None:
        part(changes, "timestamp", F.concat(F.lit("c:"), text("id")), "change", F.lit("executor"), F.concat_ws(" ", "operation", "file"), none)
    if events is not None:
        pairs = pair_tool_events(events, block)
        payload = merged_payload(F.col("start_payload"), F.col("end_payload"))
        part(pairs.withColumn("_p", payload), "start_ts", F.concat(F.lit("ev:"), text("start_seq")), "tool", none, F.coalesce(F.try_element_at("_p", F.lit("tool")), F.lit("")), none)
        moved = events.where("type = 'TaskStateChanged'")
        arrow = F.concat(F.coalesce(F.get_json_object("payload", "$.from"), F.lit("None")), F.lit(" → "), F.coalesce(F.get_json_object("payload", "$.to"), F.lit("None")))
        part(moved, "ts", F.concat(F.lit("ev:"), text("seq")), "state", F.lit(system), arrow, none)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    numbered = row_numbers(every, TASK, minute_bucket("ts"), ["ts", "key"], "n")
    return numbered.select(*ENTRY, role_for("sender").alias("sender_role"), (F.col("n") - 1).alias("seq"))


def replay_task_state(events: DataFrame) -> DataFrame:
    """State, iteration and last change of each task from its TaskStateChanged events.

    ``events(project_id, task_id, seq, to, from)``. Changes after the first terminal state are ignored; the iteration
    rises with every REPAIRING → EXECUTING. Only aggregates, so a hot task is combined before the shuffle.
    """
    ended = events.where(F.col("to").isin(fixed.TERMINAL_STATES)).groupBy(*TASK).agg(F.min("seq").alias("_end"))
    live = events.join(ended, TASK, "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    return live.groupBy(*TASK).agg(
        F.max_by("to", "seq").alias("state"), F.count_if((F.col("from") == "REPAIRING") & (F.col("to") == "EXECUTING")).alias("iteration"),
        F.max("seq").alias("last_seq"))


def replay_events(events: DataFrame, after_seq: int) -> DataFrame:
    return events.where(F.col("seq") > after_seq)


def recent_per_task(events: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` events of each task; the limit is applied before the shuffle as well."""
    order = Window.partitionBy(*TASK).orderBy(F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def recent_tasks(events: DataFrame, n: int = 20) -> DataFrame:
    return events.groupBy(*TASK).agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), *TASK).limit(n)


def budget_pack(outputs: DataFrame, keys: list[str], bucket: Column, order: list, budget: int = 60_000, note: int = 120) -> DataFrame:
    """Tool outputs under a running character budget: ``kept`` characters and ``how`` they were kept.

    full while it fits; the first that does not fit is cut to what is left minus the note; later ones get the note
    only. ``outputs(keys…, text)``. The text itself is cut, never dropped from the count.
    """
    n = F.length("text").cast("bigint")
    run = running_sum(outputs, keys, bucket, order, n, "_sum")
    before = F.col("_sum") - n
    # sums only grow, so everything after the first overflow overflows too
    full = F.col("_sum") <= budget
    first = ~full & (before < budget)
    keep = F.when(full, n).when(first, F.greatest(F.lit(budget) - before - note, F.lit(0))).otherwise(F.lit(0))
    how = F.when(full & (before < budget), "full").when(first, "cut").otherwise("note")
    packed = run.withColumn("kept", keep).withColumn("how", how).drop("_sum")
    cut = F.concat(F.col("text").substr(F.lit(1), F.col("kept").cast("int")), F.when(F.col("kept") > 0, F.lit("\n...")).otherwise(F.lit("")))
    return packed.withColumn("packed", F.when(F.col("how") == "full", F.col("text")).when(F.col("how") == "cut", cut).otherwise(F.lit("")))


def last_message(messages: DataFrame, order: str = "ord") -> DataFrame:
    return messages.groupBy(*TASK, "sender").agg(F.max_by("content", order).alias("content"))


def job_states(events: DataFrame, now: Column, timeout_seconds: int = 3600) -> DataFrame:
    """State of each job from its events ``(job_id, ts, seq, status)`` with status running, scope_required,
    completed or failed.

    A job that ran past the timeout failed; finished jobs older than the timeout are marked for cleanup.
    """
    agg = events.groupBy("job_id").agg(F.min("ts").alias("created_at"), F.max_by("status", "seq").alias("last"), F.max("ts").alias("updated_at"))
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    timed_out = (F.col("last") == "running") & (age > timeout_seconds)
    status = F.when(timed_out, "failed").otherwise(F.col("last"))
    return agg.select("job_id", "created_at", status.alias("status"), F.when(timed_out, "timeout").when(F.col("last") == "scope_required", "waiting_scope_confirmation")
                      .when(F.col("last") == "completed", "completed").when(F.col("last") == "failed", "error").otherwise("building_index").alias("phase"),
                      (status.isin("completed", "failed") & (age > timeout_seconds)).alias("cleanup"))
