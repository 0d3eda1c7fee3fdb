"""Structured Streaming over the event log and over changed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codefacts.functions import fixed
from codefacts.functions.records import progress_text
from codefacts.streaming.maintain import maintain_facts  # noqa: F401

EVENT = "project_id string, task_id string, seq bigint, ts timestamp, type string, agent_id string, payload string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def append_log(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append typed events to a log partitioned by type; the checkpoint makes a restart continue where it stopped."""
    return events.writeStream.partitionBy("type").format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def of_types(events: DataFrame, types: list[str]) -> DataFrame:
    return events.where(F.col("type").isin(types))


def progress(events: DataFrame) -> DataFrame:
    """Stateless: the short line of each event that shows something."""
    return events.select("project_id", "task_id", "seq", progress_text("type", "payload", "agent_id").alias("line")).where("line is not null")


def live_task_state(moves: DataFrame) -> DataFrame:
    """Running task state: ``moves(project_id, task_id, seq, from, to)``; changes after a terminal state are ignored.

    State per task is four values. Rows of one batch are applied in ``seq`` order; one task's rows of one batch have to fit
    a worker.
    """
    terminal = set(fixed.TERMINAL_STATES)

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, iteration, last, ended = state.get if state.exists else ("CREATED", 0, -1, False)
        rows = pd.concat([c[["seq", "from", "to"]] for c in chunks]).sort_values("seq")
        for seq, source, target in rows.itertuples(index=False):
            if ended or seq <= last:
                continue
            iteration += int(source == "REPAIRING" and target == "EXECUTING")
            name, last, ended = target, int(seq), target in terminal
        state.update((name, iteration, last, ended))
        yield pd.DataFrame({"project_id": [key[0]], "task_id": [key[1]], "state": [name], "iteration": [iteration], "last_seq": [last]})

    return moves.groupBy("project_id", "task_id").applyInPandasWithState(
        fold, f"project_id string, task_id {dict(moves.dtypes)['task_id']}, state string, iteration bigint, last_seq bigint",
        "state string, iteration bigint, last_seq bigint, ended boolean", "update", GroupStateTimeout.NoTimeout)


def live_tool_pairs(events: DataFrame) -> DataFrame:
    """Tool pairs as events arrive: a finish takes the oldest pending start of its task.

    The state holds only the starts that wait for a finish. Sources must deliver a task's events in ``seq`` order
    across batches; inside a batch they are sorted.
    """
    def pair(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        rows = pd.concat([c[["seq", "type"]] for c in chunks]).sort_values("seq")
        out = []
        for seq, kind in rows.itertuples(index=False):
            if kind == "ToolStarted":
                waiting.append(int(seq))
            elif waiting:
                out.append((key[0], key[1], waiting.pop(0), int(seq)))
        state.update((waiting,))
        yield pd.DataFrame(out, columns=["project_id", "task_id", "start_seq", "end_seq"])

    rows = events.where(F.col("type").isin("ToolStarted", "ToolFinished"))
    return rows.groupBy("project_id", "task_id").applyInPandasWithState(
        pair, f"project_id string, task_id {dict(events.dtypes)['task_id']}, start_seq bigint, end_seq bigint", "waiting array<bigint>", "append", GroupStateTimeout.NoTimeout)


def stage_monitor(events: DataFrame, interval_seconds: int = 15) -> DataFrame:
    """Current stage of each run, and a beat with the elapsed time while it neither completed nor failed.

    ``events(run_id, ts, stage, status)``; unknown stages or statuses are dropped. A processing-time timer fires
    the beats.
    """
    known = events.where(F.col("stage").isin(fixed.STAGES) & F.col("status").isin(fixed.STATUSES))
    wait = interval_seconds * 1000

    def watch(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, status, since, last = state.get if state.exists else ("", "pending", 0, 0)
        if state.hasTimedOut:
            kind = "heartbeat"
            last = max(last, state.getCurrentProcessingTimeMs())
        else:
            kind = "stage"
            rows = pd.concat([c[["ts", "stage", "status"]] for c in chunks]).sort_values("ts")
            for ts, s, st in rows.itertuples(index=False):
                at = int(ts.timestamp() * 1000)
                if s != stage:
                    stage, since = s, at
                status, last = st, at
        over = status == "failed" or (stage == "completed" and status == "completed")
        if over:
            state.remove()
        else:
            state.update((stage, status, since, last))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({"run_id": [key[0]], "kind": [kind], "stage": [stage], "status": [status], "elapsed_ms": [last - since]})

    return known.groupBy("run_id").applyInPandasWithState(
        watch, "run_id string, kind string, stage string, status string, elapsed_ms bigint", "stage string, status string, since bigint, last bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)
