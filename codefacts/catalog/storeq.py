"""Stores, state tables, manifests and logs: what is written is read again and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.aggregates import CHG, VIA, chg, deps
from codefacts.catalog.base import add
from codefacts.catalog.streams import paced, utc
from codefacts.operators import changes, hashes, relations
from codefacts.plans import documents
from codefacts.projection import PROJECT, Facts
from codefacts.session import scratch_folder
from codefacts.sources import readers, store
from codefacts.streaming import live, ordered

P = "project_id"


@add("s1_read_code_graph", "select 'node' as what, kind, count(*) as n from nodes group by kind union all select 'edge', kind, count(*) from edges group by kind")
def s1(f: Facts):
    folder = scratch_folder(f.spark)
    f.nodes.write.parquet(f"{folder}/nodes")
    f.edges.withColumn("col", F.lit(1)).write.parquet(f"{folder}/edges")
    nodes, edges = readers.read_code_graph(f.spark, folder, PROJECT)
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


@add("s15_read_index", "select path, substr(sha256(text),1,16) as content_hash, (select count(*) from sym) as symbols from docall")
def s15(f: Facts):
    root = scratch_folder(f.spark)
    store.write_index({"files": hashes.file_hashes(f.sources), "symbols": f.symbols}, root, "one")
    status, tables = store.read_index(f.spark, root)
    n = tables["symbols"].agg(F.count("*").alias("symbols"))
    return tables["files"].where(F.lit(status == "VALID")).select("path", "content_hash").crossJoin(F.broadcast(n))


@add("q29_refresh_index", "select path, substr(sha256(text),1,16) as content_hash, (select count(*) from sym) as symbols from docnew")
def q29(f: Facts):
    """A refresh brings new hashes only: the facts stay those of the first snapshot."""
    root = scratch_folder(f.spark)
    old, new = f.file_versions
    store.write_index({"files": hashes.file_hashes(old), "symbols": f.symbols}, root, "one")
    store.refresh_index(f.spark, root, "two", hashes.file_hashes(new))
    tables = store.read_index(f.spark, root)[1]
    n = tables["symbols"].agg(F.count("*").alias("symbols"))
    return tables["files"].select("path", "content_hash").crossJoin(F.broadcast(n))


@add("s18_state_tables", """
select cast(c_custkey as varchar) as task_id, concat('goal ',c_custkey) as goal, case when p > 0 then 'COMPLETED' when f > 0 then 'EXECUTING' else 'CREATED' end as state, cast(case when p > 0 then 1 else 0 end as integer) as iteration
from customer left join (select o_custkey, count(*) filter (where o_orderstatus='F') as f, count(*) filter (where o_orderstatus='P') as p from orders group by o_custkey) on o_custkey=c_custkey""")
def s18(f: Facts):
    """Tasks are inserted, changed twice and listed."""
    root = scratch_folder(f.spark)
    key = F.col("c_custkey").cast("string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tasks = f.table("customer").select(F.lit(PROJECT).alias(P), key.alias("task_id"), F.concat(F.lit("goal "), key).alias("goal"), F.lit("CREATED").alias("state"), F.lit(0).alias("iteration"), F.lit(5).alias("max_iterations"), at.alias("created_at"), at.alias("updated_at"))
    store.append_state(tasks, root, "tasks")
    for status, state, iteration in (("F", "EXECUTING", None), ("P", "COMPLETED", 1)):
        some = f.table("orders").where(F.col("o_orderstatus") == status).select(F.lit(PROJECT).alias(P), F.col("o_custkey").cast("string").alias("task_id")).distinct()
        store.update_state(some.select("*", F.lit(state).alias("state"), F.lit(iteration).cast("int").alias("iteration")), root, "tasks")
    return store.list_state(f.spark, root, "tasks").select("task_id", "goal", "state", "iteration")


@add("s17_document_manifest", """
select p.project_id, d.document, case when exists (select 1 from chg where chg.project_id=p.project_id) then 'source' when d.document='MODULES' then 'module' end as reason, d.document='MODULES' as present
from (select distinct source as project_id from documents) p, (values ('MODULES'),('ARCHITECTURE')) d(document)""", CHG)
def s17(f: Facts):
    """Two documents are recorded one after the other; the manifest then tells which are stale and which are there."""
    path = scratch_folder(f.spark)
    old, new = (hashes.source_fingerprint(v).drop("algorithm") for v in f.file_versions)
    current = lambda fp: fp.select(P, F.col("fingerprint").alias("source_fp"), F.lit("b").alias("build_fp"), F.lit("s").alias("scope_fp"))
    for name, modules in (("ARCHITECTURE", ["other", "other"]), ("MODULES", ["core", "app"])):
        made = old.select(P, F.lit(name).alias("document"), F.array(*[F.lit(m) for m in modules]).alias("modules"), F.array(F.lit("call_graph")).alias("relations"), F.array(F.lit("symbols")).alias("knowledge_sources"), F.lit(True).alias("uses_build"))
        store.record_documents(made, current(old), path)
    manifest = store.load_document_manifest(f.spark, path)
    stale = changes.stale_documents(manifest, current(new), new.select(P, F.lit("module").alias("kind"), F.lit("core").alias("name")))
    there = store.documents_present(manifest, new.select(P, F.lit("human/MODULES.md").alias("path")))
    return there.join(stale, [P, "document"], "left").select(P, "document", "reason", "present")


@add("s16_report_text", """
select project_id, string_agg(line, chr(10) order by s, k, path) as text from (
 select project_id, 0 as s, 0 as k, '' as path, concat('# Project Change Report', chr(10), chr(10), 'Source: sync', chr(10)) as line from pr
 union all select project_id, n, 0, '', concat('## ', t) from pr, (values (1,'Modified Files'),(2,'Added Files'),(3,'Deleted Files')) v(n,t)
 union all select project_id, case change when 'modified' then 1 when 'added' then 2 else 3 end, 1, path, concat('- ',path, case change when 'modified' then ' (Impact: L1)' when 'added' then ' (Impact: L3)' else '' end) from chg
 union all select project_id, n, 1, '', '- (none)' from pr, (values (1,'modified'),(2,'added'),(3,'removed')) v(n,c) where not exists (select 1 from chg where chg.project_id=pr.project_id and change=c)
 union all select project_id, n, 2, '', '' from pr, (values (1),(2),(3)) v(n)
 union all select project_id, 4, 0, '', concat('## Index Update', chr(10), '- Change Level: L3', chr(10), '- Action: incremental', chr(10), '- Fingerprint: a -> b', chr(10), chr(10), 'Status: done') from pr) group by project_id""",
     {**CHG, "pr": "select distinct source as project_id from documents"})
def s16t(f: Facts):
    values = {"origin": "sync", "level": "L3", "action": "incremental", "before": "a", "after": "b", "message": "done"}
    status = f.table("documents").select(F.col("source").alias(P)).distinct().select(P, *[F.lit(v).alias(k) for k, v in values.items()])
    return documents.texts(documents.change_report(changes.change_impact(chg(f)), status)).select(P, "text")


def tree(f: Facts):
    """A few files of each customer's repository: build files by its number, some of them in folders."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    some = [("CMakeLists.txt", k % 2 == 0), ("build.ninja", k % 3 == 0), ("Makefile", k % 5 == 0), ("sub/Makefile", k % 7 == 0), ("MDK-ARM/app.uvprojx", n % 3 == 0), ("EWARM/app.EWP", n % 4 == 0), ("board.ioc", n % 5 == 0), ("sub/board.ioc", k % 11 == 0)]
    paths = F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in some]), lambda p: p.isNotNull())
    return f.table("customer").select(k.cast("string").alias(P), F.explode(F.concat(paths, F.array(F.lit("src/a.c")))).alias("path"))


@add("s12_detect_build_system", """
select cast(c_custkey as varchar) as project_id, case when c_custkey % 13 = 0 then 'compile_commands' when c_custkey % 2 = 0 then 'cmake' when c_custkey % 3 = 0 then 'ninja' when c_custkey % 5 = 0 then 'make' when c_nationkey % 3 = 0 then 'keil'
 when c_nationkey % 4 = 0 then 'iar' when c_nationkey % 5 = 0 then 'stm32_ioc' else 'unknown' end as system from customer""")
def s12d(f: Facts):
    k = F.col("c_custkey")
    text = F.when(k % 13 == 0, '[{"file": "a.c"}]').when(k % 17 == 0, "[]")  # an empty database does not count
    db = readers.read_compile_commands(f.table("customer").select(k.cast("string").alias(P), text.alias("text")).where("text is not null"))
    found = readers.pick_build_system(readers.detect_build_systems(tree(f), db))
    return f.table("customer").select(k.cast("string").alias(P)).join(found, P, "left").select(P, F.coalesce("system", F.lit("unknown")).alias("system"))


@add("s13_legacy_and_empty_rules", """
select cast(c_custkey as varchar) as project_id, kind, pattern from customer, lateral (select 'ignore' as kind, concat('docs/',c_nationkey) as pattern where c_custkey % 3 = 0 union all select 'ignore', 'tools' where c_custkey % 3 = 0
 union all select 'project', null where c_custkey % 3 = 1 union all select 'project', 'src/**' where c_custkey % 3 = 2) x""")
def s13l(f: Facts):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    rows = f.table("customer").select(k.cast("string").alias(P), (k % 3).alias("m"), F.concat(F.lit("# old\nother:\n- no\nignore: - docs/"), n, F.lit("\n  - tools\nend:\n  - late\n")).alias("legacy"),
                                      F.when(k % 3 == 1, "project:\nignore:\n").when(k % 3 == 2, "project:\n  - src/**\n").alias("text"))
    configs = rows.where("text is not null").select(P, "text")
    return readers.load_scope_rules(configs, rows.select(P, F.col("legacy").alias("text"))).select(P, "kind", "pattern")


@add("a11_ordered_lists", """
select module, list(other order by weight desc, other) filter (where role='dependency') as dependencies, list(other order by weight desc, other) filter (where role='consumer') as consumers from (
 select "from" as module, 'dependency' as role, "to" as other, weight from deps union all select "to", 'consumer', "from", weight from deps) group by module""", VIA)
def a11o(f: Facts):
    return relations.neighbour_lists(deps(f)).select("module", F.nullif("dependencies", F.array().cast("array<string>")).alias("dependencies"), F.nullif("consumers", F.array().cast("array<string>")).alias("consumers"))


@add("t1_event_log", "select type, count(*) as n, min(seq) as first, max(seq) as last from ev group by type")
def t1(f: Facts):
    """Events that arrive out of order are appended to the log of their type; the checkpoint continues it."""
    rows = f.events.select(P, "task_id", "seq", utc().alias("ts"), "type", "payload")
    stream = paced(rows, 3_600_000, 0, "task_id").where(F.col("type") != ordered.CLOCK)
    out = scratch_folder(f.spark)
    live.append_log(stream, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return f.spark.read.parquet(f"{out}/log").groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
