"""Streams whose rows come out of order: a row is applied when the watermark says that none before it is on its way.

Every key keeps the rows that wait, the result so far, and event-time timers: one for the first waiting row, one for the next
thing due without a row (a heartbeat, the end of an idle key). A key that was idle for ``idle`` leaves no state. Rows
behind the watermark cannot be applied in order any more; Spark counts them, see ``late_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codefacts.functions import fixed
from codefacts.session import scratch_folder
from codefacts.sources.store import read_or_empty

#: Type of a row that only moves the watermark on; sources send one when nothing happens.
CLOCK = "Clock"


class InOrder(StatefulProcessor):
    """Applies the rows of a key in order of time and ``seq``; what they mean is up to the subclass."""

    #: Columns that ``apply`` gets, after ``at`` (milliseconds) and ``seq``; their types; the memory of a key; its start.
    columns: tuple[str, ...] = ()
    waiting_schema = "at bigint, seq bigint"
    memory_schema = "last bigint"
    start: tuple = ()

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.memory = handle.getValueState("memory", self.memory_schema + ", active bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            kept = frame[frame["type"] != CLOCK]
            new += [(int(at), int(seq), *rest) for at, seq, *rest in kept[["at", "seq", *self.columns]].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            first = min(r[0] for r in new)
            timers = list(self.handle.listTimers())
            if not timers or min(timers) > first:
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= now), key=lambda r: r[:2])
        left = [r for r in rows if r[0] > now]
        *memory, active = self.memory.get() if self.memory.exists() else (*self.start, ready[0][0] if ready else now)
        out: list[tuple] = []
        while True:  # rows up to a silence of ``idle`` belong together, whichever batches brought them
            n = 0
            while n < len(ready) and ready[n][0] <= active + self.idle_ms:
                active, n = max(active, ready[n][0]), n + 1
            ends = active + self.idle_ms
            memory, emitted = self.apply(memory, ready[:n], min(now, ends))
            out += emitted
            ready = ready[n:]
            if not ready:
                break
            memory, active = list(self.start), ready[0][0]
        if len(left) < len(rows):
            self.waiting.put(left) if left else self.waiting.clear()
        if ends <= now:
            self.memory.clear()
        else:
            self.memory.update((*memory, active))
        due = [r[0] for r in left] + ([ends, *self.due(memory)] if ends > now else [])
        if due:
            self.handle.registerTimer(max(now + 1, min(due)))
        if out:
            names = key if isinstance(key, tuple) else (key,)
            yield pd.DataFrame([(*names, *o) for o in out])

    def apply(self, memory: list, ready: list[tuple], now: int) -> tuple[list, list[tuple]]:
        """Memory after the ``ready`` rows and all that is due up to ``now``, and the rows to emit."""
        raise NotImplementedError

    def due(self, memory: list) -> list[int]:
        """Times at which something happens without a row."""
        return []

    def close(self) -> None:
        pass


class TaskState(InOrder):
    """State, iteration and last change of a task; changes after a terminal state are ignored."""

    columns = ("source", "target")
    waiting_schema = "at bigint, seq bigint, source string, target string"
    memory_schema = "state string, iteration bigint, last_seq bigint, ended boolean"
    start = ("CREATED", 0, -1, False)

    def apply(self, memory: list, ready: list[tuple], now: int) -> tuple[list, list[tuple]]:
        state, iteration, last, ended = memory
        before = last
        for _, seq, source, target in ready:
            if not ended:
                iteration += int(source == "REPAIRING" and target == "EXECUTING")
                state, last, ended = target, seq, target in fixed.TERMINAL_STATES
        return [state, iteration, last, ended], [(state, iteration, last)] if last != before else []


class ToolPairs(InOrder):
    """Every finish takes the oldest pending start of its task; starts older than the idle time stop waiting."""

    columns = ("type",)
    waiting_schema = "at bigint, seq bigint, type string"
    memory_schema = "starts array<bigint>, times array<bigint>"
    start = ([], [])

    def apply(self, memory: list, ready: list[tuple], now: int) -> tuple[list, list[tuple]]:
        starts, out = list(zip(memory[0], memory[1], strict=True)), []
        for at, seq, kind in ready:
            if kind == "ToolStarted":
                starts.append((seq, at))
            elif kind == "ToolFinished":
                starts = [s for s in starts if s[1] + self.idle_ms >= at]
                if starts:
                    out.append((starts.pop(0)[0], seq))
        return [[s[0] for s in starts], [s[1] for s in starts]], out


class StageBeats(InOrder):
    """The stage a run is in, and a beat at every interval of event time while it is running.

    A running event starts its stage anew; completed or failed ends the stage if it is the one that runs.
    """

    columns = ("stage", "status")
    waiting_schema = "at bigint, seq bigint, stage string, status string"
    memory_schema = "stage string, since bigint, next bigint"
    start = ("", 0, 0)

    def __init__(self, idle_ms: int, interval_ms: int):
        super().__init__(idle_ms)
        self.interval_ms = interval_ms

    def apply(self, memory: list, ready: list[tuple], now: int) -> tuple[list, list[tuple]]:
        stage, since, due = memory
        out: list[tuple] = []

        def beats(until: int) -> None:
            nonlocal due
            while stage and due < until:
                out.append(("heartbeat", due, stage, "running", due - since))
                due += self.interval_ms

        for at, _, name, status in ready:
            beats(at)
            if status == "running":
                stage, since, due = name, at, at + self.interval_ms
            elif status in ("completed", "failed") and name == stage:
                stage = ""
            out.append(("stage", at, name, status, 0))
        beats(now + 1)
        return [stage, since, due], out

    def due(self, memory: list) -> list[int]:
        return [memory[2]] if memory[0] else []


def _ordered(rows: DataFrame, keys: list[str], processor: InOrder, out: str, delay: str) -> DataFrame:
    """Runs ``processor`` for every key; ``delay`` is how late a row may come.

    ``at`` is the event time in whole milliseconds, never before it. Rows without a time or a ``seq`` have no place in any order
    and are left out. Keys travel as strings, as a null among numbers would turn them into floating point.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(rows.dtypes)
    timed = rows.withWatermark("ts", delay).where("ts is not null and seq is not null").withColumns(
        {"at": F.ceil(F.unix_micros("ts") / 1000).cast("long"), **{k: F.col(k).cast("string") for k in keys}})
    schema = ", ".join(f"{k} string" for k in keys) + ", " + out
    found = timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")
    return found.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})


def task_state(moves: DataFrame, delay: str, idle_ms: int) -> DataFrame:
    """Task states as they change: ``moves(project_id, task_id, seq, ts, type, from, to)`` in any order within ``delay``.

    Emits a row whenever a task moved. A task that was idle for ``idle_ms`` is forgotten, a terminal one as well.
    """
    rows = moves.withColumnsRenamed({"from": "source", "to": "target"})
    return _ordered(rows, ["project_id", "task_id"], TaskState(idle_ms), "state string, iteration bigint, last_seq bigint", delay)


def tool_pairs(events: DataFrame, delay: str, idle_ms: int) -> DataFrame:
    """Tool calls as they finish: ``events(project_id, task_id, seq, ts, type)`` in any order within ``delay``.

    A start that no finish took within ``idle_ms`` stops waiting.
    """
    rows = events.where(F.col("type").isin("ToolStarted", "ToolFinished", CLOCK))
    return _ordered(rows, ["project_id", "task_id"], ToolPairs(idle_ms), "start_seq bigint, end_seq bigint", delay)


def stage_beats(events: DataFrame, delay: str, idle_ms: int, interval_seconds: int = 15) -> DataFrame:
    """Stage changes and heartbeats of runs: ``events(run_id, seq, ts, type, stage, status)`` in any order within ``delay``.

    ``at`` is the event time in milliseconds, ``elapsed_ms`` counts from the start of the stage. Unknown stages and
    statuses are dropped. The watermark closes a run: without any event for ``idle_ms`` it beats no more.
    """
    known = (F.col("stage").isin(fixed.STAGES) & F.col("status").isin(fixed.STATUSES)) | (F.col("type") == CLOCK)
    out = "kind string, at bigint, stage string, status string, elapsed_ms bigint"
    return _ordered(events.where(known), ["run_id"], StageBeats(idle_ms, interval_seconds * 1000), out, delay)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark since the query started, over the batches whose progress Spark still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows of state that the query holds after its last batch."""
    return sum(int(s["numRowsTotal"]) for s in query.lastProgress["stateOperators"]) if query.lastProgress else 0


def drained(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Runs ``stream`` over all that is available and returns the rows it emitted, with the number of their ``batch``.

    A batch that runs again overwrites its own folder, so a lost driver or executor adds nothing twice. Late rows are an
    error: they would be missing from the result.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if late_rows(query):
        raise RuntimeError(f"{late_rows(query)} rows came behind the watermark; allow a longer delay")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", batch bigint"
    return read_or_empty(spark, f"{folder}/out", schema), query  # a source without any file runs no batch
