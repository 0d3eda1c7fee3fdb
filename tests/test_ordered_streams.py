"""Streams whose rows come out of order: equal to a plain replay in any batching, late rows told, idle keys forgotten."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codefacts.functions import fixed
from codefacts.streaming import ordered

CLOCK_AT = 10_000_000.0
MOVES = "project_id string, task_id string, seq bigint, ts timestamp, type string, `from` string, `to` string"


def stream(spark, folder, rows, schema, delay, batches, seed=1, clock=True):
    """Rows (with ``seq`` and ``ts`` in seconds) that arrive up to ``delay`` seconds late, in so many batches."""
    rng = random.Random(seed)
    names = [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]
    arrived = sorted(rows, key=lambda r: r["ts"] + rng.uniform(0, delay))
    if clock:
        arrived.append({n: None for n in names} | {"seq": -1, "ts": CLOCK_AT, "type": ordered.CLOCK})
    size = -(-len(arrived) // batches)
    for k in range(0, len(arrived), size):
        part = [tuple(float(r[n]) if n == "ts" else r[n] for n in names) for r in arrived[k : k + size]]
        plain = spark.createDataFrame(part, schema.replace("timestamp", "double")).withColumn("ts", F.timestamp_seconds("ts"))
        plain.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def random_moves(n, seed):
    rng = random.Random(seed)
    states = ["EXECUTING", "REPAIRING", "REVIEWING", "COMPLETED"]
    return [{"project_id": "p", "task_id": f"t{rng.randrange(6)}", "seq": i, "ts": i * 10 + rng.random() * 9, "type": "TaskStateChanged", "from": rng.choice(states),
             "to": rng.choices(states, [9, 9, 9, 1])[0]} for i in range(n)]


@pytest.mark.parametrize("batches", [1, 4])
def test_task_states_in_any_order(spark, tmp_path, batches):
    rows = random_moves(150, 3)
    out, query = ordered.drained(ordered.task_state(stream(spark, tmp_path / "in", rows, MOVES, 200, batches), "200 seconds", 10**9))
    last = out.groupBy("task_id").agg(F.max_by(F.struct("state", "iteration", "last_seq"), "last_seq").alias("s")).select("task_id", "s.*")
    want = {}
    for r in rows:
        state, iteration, seq, ended = want.get(r["task_id"], ("CREATED", 0, -1, False))
        if not ended:
            iteration += r["from"] == "REPAIRING" and r["to"] == "EXECUTING"
            want[r["task_id"]] = (r["to"], iteration, r["seq"], r["to"] in fixed.TERMINAL_STATES)
    assert sorted(tuple(r) for r in last.collect()) == sorted((k, *v[:3]) for k, v in want.items())
    assert ordered.state_rows(query) == 0  # the idle time has passed


def test_late_rows_are_an_error(spark, tmp_path):
    rows = random_moves(60, 4)
    with pytest.raises(RuntimeError, match="behind the watermark"):
        ordered.drained(ordered.task_state(stream(spark, tmp_path / "in", rows, MOVES, 300, 4), "1 second", 10**9))


def brute_pairs(rows, idle):
    waiting, active, out = {}, {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        key, now = r["task_id"], r["ts"]
        if key in active and now - active[key] > idle:
            waiting[key] = []
        active[key] = now
        own = waiting.setdefault(key, [])
        if r["type"] == "ToolStarted":
            own.append(r)
        else:
            own[:] = [s for s in own if now - s["ts"] <= idle]
            if own:
                out.append((key, own.pop(0)["seq"], r["seq"]))
    return sorted(out, key=str)


def test_pairs_and_idle_keys(spark, tmp_path):
    rng = random.Random(6)
    rows, at = [], 0
    for i in range(160):
        at += rng.choice([10, 20, 400])
        rows.append({"project_id": "p", "task_id": rng.choice(["a", "b", "c", None]), "seq": i, "ts": at, "type": rng.choice(["ToolStarted", "ToolFinished"])})
    schema = "project_id string, task_id string, seq bigint, ts timestamp, type string"
    want = brute_pairs(rows, 900)
    assert 10 < len(want) < 70
    for batches in (2, 5):
        source = stream(spark, tmp_path / f"in{batches}", rows, schema, 300, batches, seed=batches)
        out, query = ordered.drained(ordered.tool_pairs(source, "300 seconds", 900_000))
        assert sorted(((r["task_id"], r["start_seq"], r["end_seq"]) for r in out.collect()), key=str) == want
        assert ordered.state_rows(query) == 0  # every key has been idle for longer than it may


def test_beats_by_event_time(spark, tmp_path):
    schema = "run_id string, seq bigint, ts timestamp, type string, stage string, status string"
    line = lambda run, seq, ts, stage, status: {"run_id": run, "seq": seq, "ts": 1000 + ts, "type": "Stage", "stage": stage, "status": status}
    rows = [line("r", 0, 0, "planning", "running"), line("r", 1, 32, "review", "running"), line("r", 2, 40, "planning", "completed"), line("r", 3, 62, "review", "completed"),
            line("q", 4, 100, "verify", "running"), line("q", 5, 101, "nonsense", "running"), line("q", 6, 500, "verify", "failed")]
    out, query = ordered.drained(ordered.stage_beats(stream(spark, tmp_path / "in", rows, schema, 20, 3), "20 seconds", 60_000))
    beats = sorted((r["run_id"], r["at"], r["stage"], r["elapsed_ms"]) for r in out.where("kind = 'heartbeat'").collect())
    assert beats == [*(("q", 1_100_000 + k, "verify", k) for k in (15_000, 30_000, 45_000, 60_000)), ("r", 1_015_000, "planning", 15_000), ("r", 1_030_000, "planning", 30_000),
                     ("r", 1_047_000, "review", 15_000)]
    assert out.where("kind = 'stage'").count() == 6 and ordered.state_rows(query) == 0
