"""Stores, files on disk, streams against their batch twins, and the driver contract."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from codefacts.catalog import tasks
from codefacts.operators import candidates, timeline
from codefacts.plans import refresh
from codefacts.projection import Facts
from codefacts.sources import readers, store
from codefacts.streaming import live

SF = "/root/testdata/sf0.001"
P = "p"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_read_tree_and_graph(spark, tmp_path):
    for rel, text in {"src/a.c": '#include "a.h"\nint x;', "build/b.c": "x", "Makefile": "all: src/a.c", "notes.txt": "n"}.items():
        p = tmp_path / "proj" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    tree = readers.read_tree(spark, str(tmp_path / "proj"), P)
    assert rows(readers.scan_files(tree).select("path", "language")) == [("Makefile", "unknown"), ("src/a.c", "c")]
    text = readers.scan_code_files(tree).withColumn("text", F.col("content").cast("string"))
    assert rows(readers.scan_includes(text).select("src", "target", "ord")) == [("src/a.c", "a.h", 1)]
    f = Facts(spark, SF)
    f.nodes.write.parquet(str(tmp_path / "g/nodes"))
    f.edges.withColumn("col", F.lit(1)).write.parquet(str(tmp_path / "g/edges"))
    n, e = readers.read_code_graph(spark, str(tmp_path / "g"), P)
    assert n.count() == f.nodes.count() and e.count() == f.edges.count()


def test_snapshots_and_state(spark, tmp_path):
    root = str(tmp_path / "idx")
    assert store.read_index(spark, root)[0] == "MISSING"
    files = spark.createDataFrame([(P, "a.c", "h1")], "project_id string, path string, content_hash string")
    assert store.write_index({"files": files, "symbols": files}, root, "s1", 1)
    assert not store.write_index({"files": files}, root, "s1b", 1)  # a replayed batch changes nothing
    assert store.refresh_index(spark, root, "s2", files.withColumn("content_hash", F.lit("h2")))
    status, tables = store.read_index(spark, root)
    assert status == "VALID" and tables["files"].first().content_hash == "h2" and tables["symbols"].first().content_hash == "h1"
    ev = spark.createDataFrame([(P, "t", i, "X", None, "{}", None) for i in range(5)], "project_id string, task_id string, seq bigint, type string, agent_id string, payload string, ts timestamp")
    store.append_state(ev, str(tmp_path / "st"), "events")
    assert [r.seq for r in store.list_state(spark, str(tmp_path / "st"), "events", "t", 2).collect()] == [3, 4]
    assert store.list_state(spark, str(tmp_path / "st"), "tasks").count() == 0
    assert store.load_responsibilities(spark, str(tmp_path / "none")).count() == 0


def test_gate(spark):
    c = [(P, 1, "A", "HIGH", 1.0, 2, 0), (P, 2, "A", "HIGH", 1.0, 3, 6), (P, 2, "B", "HIGH", 0.9, 2, 0)]
    ranked = candidates.rank_candidates(spark.createDataFrame(c, "project_id string, query_id int, module string, confidence string, score double, n_sources int, n_impacted int"))
    mods = spark.createDataFrame([(P, "A", "unknown"), (P, "B", "app")], "project_id string, module string, type string")
    none = spark.createDataFrame([], "project_id string, module string, n bigint")
    imp = spark.createDataFrame([], "project_id string, module string, other string")
    got = {r.query_id: r for r in candidates.evaluate_gate(ranked, none, none, imp, mods).collect()}
    assert not got[1].confirm and got[1].selected == "A"
    assert got[2].confirm and got[2].reasons == "several_candidates,close_scores,large_impact"


def _drain(query):
    query.awaitTermination()


def _collect(spark, stream, tmp: Path, mode: str):
    """Run a stream over all available input and keep every emitted row with its batch id."""
    out = str(tmp / "out")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp / "ck")).trigger(availableNow=True).foreachBatch(
        lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start()
    _drain(q)
    return spark.read.parquet(out)


def test_streams_equal_batch(spark, tmp_path):
    f = Facts(spark, SF)
    ev = f.events.withColumn("agent_id", F.lit(None).cast("string"))
    for i, cond in enumerate(("seq < 400", "seq >= 400")):
        ev.where(cond).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    schema = "project_id string, seq bigint, task_id bigint, ts timestamp, type string, value double, payload string, agent_id string, part int"
    events = live.read_events(spark, str(tmp_path / "in"), schema, 1)
    got = _collect(spark, live.live_tool_pairs(events), tmp_path / "pairs", "append").select("task_id", "start_seq", "end_seq")
    assert rows(got) == rows(timeline.pair_tool_events(f.events).select("task_id", "start_seq", "end_seq"))
    moves = tasks.moves(Facts(spark, SF)).select("project_id", "task_id", "seq", "from", "to")
    for i, cond in enumerate(("seq < 400", "seq >= 400")):
        moves.where(cond).coalesce(1).write.parquet(str(tmp_path / f"mv/part={i}"))
    stream = live.live_task_state(live.read_events(spark, str(tmp_path / "mv"), "project_id string, task_id bigint, seq bigint, `from` string, `to` string, part int", 1))
    every = _collect(spark, stream, tmp_path / "state", "update")
    last = every.groupBy("task_id").agg(F.max_by(F.struct("state", "iteration", "last_seq"), "batch").alias("s")).select("task_id", "s.*")
    assert rows(last) == rows(timeline.replay_task_state(moves).select("task_id", "state", "iteration", "last_seq"))
    _drain(live.append_log(events, str(tmp_path / "log"), str(tmp_path / "logck")))
    assert spark.read.parquet(str(tmp_path / "log")).count() == f.events.count()
    assert live.of_types(live.progress(events.withColumn("type", F.lit("AgentThinking"))).withColumn("type", F.lit("x")), ["x"]).isStreaming


def test_stage_monitor(spark, tmp_path):
    data = [("r1", "2024-01-01 00:00:00", "planning", "running"), ("r1", "2024-01-01 00:00:05", "completed", "completed"), ("r2", "2024-01-01 00:00:00", "review", "running"), ("r2", "2024-01-01 00:00:01", "nonsense", "running")]
    df = spark.createDataFrame(data, "run_id string, t string, stage string, status string").select("run_id", F.to_timestamp("t").alias("ts"), "stage", "status")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.stage_monitor(live.read_events(spark, str(tmp_path / "in"), "run_id string, ts timestamp, stage string, status string"))
    # processing-time timers keep a stream alive, so it is stopped by hand
    out = str(tmp_path / "out")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).start()
    q.awaitTermination(25)
    q.stop()
    got = {r.run_id: r for r in spark.read.parquet(out).where("kind = 'stage'").collect()}
    assert got["r1"].stage == "completed" and got["r2"].stage == "review" and got["r2"].status == "running"


def test_fact_stream_equals_full_build(spark, tmp_path):
    text = "#define N 1\nint run(int a) {\n  p->x = a;\n}"
    first = [(P, "a.c", text), (P, "b.c", text)]
    second = [(P, "b.c", text.replace("N 1", "N 2")), ("big", "x.c", text)]
    schema = "project_id string, path string, text string"
    for i, part in enumerate((first, second)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
        stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        _drain(live.maintain_facts(stream.drop("part"), str(tmp_path / "idx"), str(tmp_path / "ck")))
    status, tables = store.read_index(spark, str(tmp_path / "idx"))
    full = refresh.extract_facts(spark.createDataFrame([first[0], *second], schema))
    assert status == "VALID"
    for name in ("files", *refresh.FACTS):
        assert rows(tables[name].select(*full[name].columns)) == rows(full[name]), name
