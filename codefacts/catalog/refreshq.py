"""Freshness, refresh, documents and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.aggregates import CHG, VIA, chg, deps, mfiles, one_build
from codefacts.catalog.base import add
from codefacts.catalog.joins import INDIRECT_VIEW, indirect
from codefacts.catalog.questionq import HITS, answers
from codefacts.catalog.sourceq import c_sources
from codefacts.functions import records
from codefacts.operators import changes, extract, hashes, quality, relations
from codefacts.plans import refresh, relations_refresh, reports
from codefacts.projection import Facts
from codefacts.session import cut_lineage
from codefacts.sources import store


def projects(f: Facts):
    return f.table("documents").select(F.col("source").alias("project_id")).distinct()


def state_inputs(f: Facts):
    """Stored and current fingerprints per source; every third source changes its build, every second its scope."""
    n = F.regexp_extract("project_id", r"(\d+)$", 1).cast("int")
    p = projects(f).withColumn("n", n)
    old, new = (hashes.source_fingerprint(v).drop("algorithm").withColumnRenamed("fingerprint", "source_fp") for v in f.file_versions)
    size = f.file_versions[0].groupBy("project_id").agg(F.count("*").alias("files"))
    stored = p.join(old, "project_id").join(size, "project_id").select("project_id", F.lit("b0").alias("build_fp"), F.lit("s0").alias("scope_fp"), "source_fp", F.lit(100).alias("build_files"), "files")
    current = p.join(new, "project_id").select("project_id", F.when(F.col("n") % 3 == 0, "b1").otherwise("b0").alias("build_fp"), F.when(F.col("n") % 2 == 0, "s1").otherwise("s0").alias("scope_fp"),
                                               "source_fp", (F.lit(100) + F.col("n") * 3).alias("build_files"))
    moves = p.select("project_id", (F.col("n") * 5).alias("moves"))
    return stored, current, moves


def freshness(f: Facts):
    stored, current, moves = state_inputs(f)
    return changes.evaluate_index_state(stored, current, moves, changes.classify_source_change(chg(f), projects(f)))


FRESH = {**CHG, "fr": """select p.project_id, p.n, case when n % 3=0 and (n*3 > 50 or n*3/100 > 0.2) then 'build' when n % 2=0 then 'scope' when coalesce(c.ch,0) > 0 then 'source' else 'none' end as cause,
  n*5 as moves, n*3 as build_delta, o.files, coalesce(c.ch,0) as ch, coalesce(c.h,0) as h from (select distinct source as project_id, cast(regexp_extract(source,'(\\d+)$',1) as integer) as n from documents) p join (select project_id, count(*) as files from docold group by project_id) o on o.project_id=p.project_id
  left join (select project_id, count(*) as ch, 0 as h from chg group by project_id) c on c.project_id=p.project_id""",
         "fresh": """select project_id, cause, case when cause='build' then 'REINDEX_REQUIRED' when cause='scope' then case when moves > 50 or (moves/files > 0.1 and moves >= 20) then 'REINDEX_REQUIRED' else 'STALE_RECOMMENDED' end
  when cause='source' then case when ch > 100 then 'REINDEX_REQUIRED' else 'STALE_RECOMMENDED' end else 'VALID' end as state, moves, build_delta from fr"""}


@add("q19_evaluate_index_state", "select * from fresh", FRESH)
def q19(f: Facts):
    return freshness(f)


@add("q21_sync_decision", """
select project_id, case when cause='none' and false then '' when right(project_id,1)='9' then 'create' when right(project_id,1)='8' then 'fingerprint_only' when state='REINDEX_REQUIRED' then 'reindex_required' when cause='scope' then 'reclassify'
 when (select count(*) from chg where chg.project_id=fresh.project_id)=0 then 'fingerprint_only' else 'incremental' end as action, (select count(*) from chg where chg.project_id=fresh.project_id) as changed_files from fresh""", FRESH)
def q21(f: Facts):
    last = F.substring("project_id", -1, 1)
    p = projects(f).select("project_id", (last != "9").alias("has_index"))
    comments = projects(f).select("project_id", (last == "8").alias("comment_only"))
    return refresh.sync_decision(p, chg(f), comments, freshness(f))


@add("q22_full_facts", """
select t, count(*) as n from (select 'macros' as t from part union all select 'functions' from part union all select unnest(['enums','enums','enums','enums','enums','fields','fields','fields','usage','usage','usage','bindings','bindings','bindings']) from part) group by t""")
def q22(f: Facts):
    files = c_sources(f)
    facts = refresh.extract_facts(files, seen=cut_lineage(extract.bracket_facts(extract.size_guard(files)[0])))
    parts = [facts[n].select(F.lit(n).alias("t")) for n in refresh.FACTS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("t").agg(F.count("*").alias("n"))


@add("q21_incremental_update", """
select path, concat('MAX_',p_partkey) as name, case when p_size > 25 then '1' else cast(p_size as varchar) end as value from (select *, concat('src/p',p_partkey,case when p_size % 2=0 then '.c' else '.h' end) as path from part) where p_size <> 50""")
def q21i(f: Facts):
    old = c_sources(f)
    size = F.regexp_extract("text", r"#define MAX_\d+ (\d+)", 1).cast("int")
    new = old.where(size != 50).withColumn("text", F.when(size > 25, F.regexp_replace("text", r"(#define MAX_\d+) \d+", "$1 1")).otherwise(F.col("text")))
    return refresh.incremental_update(refresh.extract_facts(old), new)["macros"].select("path", "name", "value")


@add("q25_index_status", """
select p.project_id, case when right(p.project_id,1)='9' then 'MISSING' when right(p.project_id,1)='7' then 'CORRUPTED' when exists (select 1 from chg where chg.project_id=p.project_id) then 'STALE' else 'VALID' end as status from (select distinct source as project_id from documents) p""", CHG)
def q25(f: Facts):
    old, new = (hashes.source_fingerprint(v).drop("algorithm") for v in f.file_versions)
    last = F.substring("project_id", -1, 1)
    snap = old.where(last != "9").withColumn("schema_version", F.when(last == "7", "1").otherwise("2"))
    return changes.index_status(snap, new)


@add("q26_understanding_status", """
select p.project_id, case when right(p.project_id,1)='9' then 'missing' when exists (select 1 from chg where chg.project_id=p.project_id) then 'outdated' else 'usable' end as status from (select distinct source as project_id from documents) p""", CHG)
def q26(f: Facts):
    old, new = (hashes.source_fingerprint(v).drop("algorithm") for v in f.file_versions)
    return refresh.understanding_status(old.where(F.substring("project_id", -1, 1) != "9").withColumnRenamed("fingerprint", "based_on"), new)


@add("q26_hits_goal", "select distinct query_id from (select query_id from hfs join files f on f.path=hfs.path where f.compile_status='excluded' union select query_id from sh join sym s on s.name=sh.name where s.type='macro')", HITS)
def q26h(f: Facts):
    a = answers(f)
    return refresh.hits_goal(a.hit_files(), a.symbols, f.files.where("compile_status = 'excluded'"), f.symbols.where("type = 'macro'")).select("query_id")


@add("q27_stale_documents", """
select p.project_id, d.document, case when exists (select 1 from chg where chg.project_id=p.project_id) then 'source' when d.document='MODULES' then 'module' end as reason from (select distinct source as project_id from documents) p, (values ('MODULES'),('ARCHITECTURE')) d(document)
where exists (select 1 from chg where chg.project_id=p.project_id) or d.document='MODULES'""", CHG)
def q27(f: Facts):
    old, new = (hashes.source_fingerprint(v).drop("algorithm") for v in f.file_versions)
    docs = F.explode(F.array(F.lit("MODULES"), F.lit("ARCHITECTURE"))).alias("document")
    manifest = old.select("project_id", docs, F.col("fingerprint").alias("source_fp"), F.lit("b").alias("build_fp"), F.lit(True).alias("uses_build")).withColumn(
        "modules", F.when(F.col("document") == "MODULES", F.array(F.lit("core"))).otherwise(F.array(F.lit("other")))).withColumn("relations", F.array(F.lit("call_graph")))
    current = new.select("project_id", F.col("fingerprint").alias("source_fp"), F.lit("b").alias("build_fp"))
    touched = new.select("project_id", F.lit("module").alias("kind"), F.lit("core").alias("name"))
    return changes.stale_documents(manifest, current, touched)


@add("q27_changed_modules", "select distinct module from (select file, min(module) as module from sym group by file) m join files f on f.path=m.file where compile_status='excluded'")
def q27m(f: Facts):
    return changes.changed_modules(f.files.where("compile_status = 'excluded'"), mfiles(f)).select("module")


@add("s16_change_report", "select project_id, change as section, path, concat('- ',path, case when change='removed' then '' when change='added' then ' (Impact: L3)' else ' (Impact: L1)' end) as line from chg", CHG)
def s16(f: Facts):
    return store.change_report(changes.change_impact(chg(f)))


@add("s19_overview_document", """
select 'firmware' as project_id, concat('# firmware\n\n## 2. Runtime Environment\n- MCU / CPU: `Cortex-M4`\n- RTOS: `None detected / Unknown`\n\n## 3. Build Reality\n- Build Target: `main` [Fact]\n- Project files: `',(select count(*) from files),'` [Fact]\n- Compiled files: `',(select count(*) from files where compile_status='compiled'),
 '`\n\n## 7. Engineering Characteristics\n- Module count: `',(select count(distinct module) from sym),'` [Fact]\n- Symbol count: `',(select count(*) from sym),'` [Fact]\n- Call edges: `',(select count(*) from calls),'` [Fact]') as text""")
def s19(f: Facts):
    build = f.files.where("compile_status in ('compiled','excluded')").select("project_id", "path", (F.col("compile_status") == "compiled").alias("compiled"))
    facts = quality.overview_facts(f.files, f.symbols, f.calls, indirect(f), f.symbols.select("project_id", "module").distinct(), build, one_build(f))
    return reports.overview_document(facts)


@add("s19_architecture_document", """
select 'firmware' as project_id, concat('# System Architecture\n\n## 3. Major Modules\n',(select string_agg(concat('- `',module,'` (app, build=compiled)'), '\n' order by module) from (select distinct module from sym order by 1 limit 30)),
 '\n\n## 4. Module Dependencies\n| From | To | Weight |\n|---|---|---:|\n',(select string_agg(concat('| `',"from",'` | `',"to",'` | ',weight,' |'), '\n' order by weight desc, "from", "to") from (select * from deps order by weight desc, "from", "to" limit 40)),
 '\n\n## 7. Callback / Indirect Call Areas\n| File | Via | Callee |\n|---|---|---|\n',(select string_agg(concat('| `',file,'` | ',via,' | `',callee,'` |'), '\n' order by file, via) from (select file, via, min(callee) as callee from indirect group by file, via order by file, via limit 20))) as text""", {**VIA, **INDIRECT_VIEW})
def s19a(f: Facts):
    m = f.symbols.select("project_id", "module").distinct().select("project_id", "module", F.lit("app").alias("type"), F.lit("compiled").alias("build_status"))
    return reports.architecture_document(m, deps(f), indirect(f))


@add("w13_module_map", "select module, concat(case n % 3 when 0 then '0' when 1 then '1' else '2' end,':',module) as position from (select module, count(*) as n from sym group by module)")
def w13(f: Facts):
    n = f.symbols.groupBy("project_id", "module").agg(F.count("*").alias("n"))
    c = F.when(F.col("n") % 3 == 0, "high").when(F.col("n") % 3 == 1, "medium").otherwise("low")
    return reports.module_map(n.withColumn("confidence", c)).select("module", "position")


@add("t6_progress_text", "select seq, case type when 'ToolStarted' then concat('工具: make ', 'f', seq % 7, '.c') else '完成: make [OK]' end as line from ev where type in ('ToolStarted','ToolFinished')")
def t6(f: Facts):
    payload = F.to_json(F.struct(F.lit("make").alias("tool"), F.lit(True).alias("ok"), F.struct(F.concat(F.lit("f"), (F.col("seq") % 7).cast("string"), F.lit(".c")).alias("path")).alias("args")))
    line = records.progress_text("type", payload, F.lit(None).cast("string"))
    return f.events.select("seq", line.alias("line")).where("line is not null")


@add("a11_dependency_lists", 'select "from" as module, count(*) as n, cast(sum(weight) as bigint) as weight from deps group by 1', VIA)
def a11l(f: Facts):
    return relations.module_dependencies(relations.dependency_via(f.calls, f.includes, f.symbols.select("project_id", "module", "name", "ord"), mfiles(f))).groupBy(
        F.col("from").alias("module")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def relation_version(f: Facts, new: bool) -> dict:
    """Two versions of a project: calls of the first and of the last lines, some symbols in another module, some files excluded."""
    calls = f.calls.where("line >= 2" if new else "line <= 5")
    includes = calls.where(F.endswith("callee_file", F.lit(".h")) & (F.col("file") != F.col("callee_file"))).select("project_id", F.col("file").alias("src"), F.col("callee_file").alias("target")).distinct()
    sym = f.symbols.withColumn("module", F.when(F.col("ord") % 50 == 3, "Moved").otherwise(F.col("module"))) if new else f.symbols
    status = F.when(F.col("ord") % 9 == 0, "excluded").otherwise(F.col("compile_status")) if new else F.col("compile_status")
    return {
        "calls": calls.select("project_id", "caller", "callee", "file", "confidence"), "includes": includes, "module_symbols": sym.select("project_id", "name", "module"),
        "module_files": sym.select("project_id", F.col("file").alias("path"), "module").distinct(), "files": f.files.select("project_id", "path", status.alias("compile_status")),
    }


SECOND = {
    "sym2": "select * replace (case when ord % 50 = 3 then 'Moved' else module end as module) from sym",
    "calls2": "select * from calls where line >= 2",
    "inc2": "select distinct file as src, callee_file as target from calls2 where callee_file like '%.h' and file <> callee_file",
    "byfile2": "select file, max(module) as module from sym2 group by file",
    "via2": """select m1 as "from", m2 as "to", kind, via, cast(sum(w) as bigint) as weight from (
      select a.module as m1, b.module as m2, 'call' as kind, callee as via, 3 + case when confidence='high' then 1 else 0 end as w from calls2 c join sym2 a on a.name=c.caller join sym2 b on b.name=c.callee where a.module <> b.module
      union all select a.module, b.module, 'include', target, 2 from inc2 i join byfile2 a on a.file=i.src join byfile2 b on b.file=i.target where a.module <> b.module) group by all""",
    "deps2": """select "from", "to", cast(sum(weight) as bigint) as weight, case when bool_or(kind='call') and bool_or(kind='include') then 'call,include' when bool_or(kind='call') then 'call' else 'include' end as kinds,
      count(distinct via) as via_count from via2 group by all""",
    "near2": """select *, row_number() over (partition by module, role order by weight desc, other) as rank from (
      select "from" as module, 'dependency' as role, "to" as other, weight from deps2 union all select "to", 'consumer', "from", weight from deps2)""",
}


@add("q21_refresh_relations", """
select 'dependency' as what, "from" as a, "to" as b, kinds as text, weight as n, via_count as m from deps2
union all select 'link', least("from","to"), greatest("from","to"), null, null, null from via2 group by all
union all select 'neighbour', module, other, role, weight, rank from near2 where rank <= 10
union all select 'build', s.module, null, ['compiled','not_compiled','excluded'][min(case st when 'compiled' then 1 when 'not_compiled' then 2 else 3 end)], count(*) filter (where st='compiled'), count(*)
 from (select distinct module, file from sym2) s join (select path, case when ord % 9 = 0 then 'excluded' else compile_status end as st from files) f on f.path=s.file group by s.module""", SECOND)
def q21r(f: Facts):
    """The state of the first version, refreshed by the signed changes to the second."""
    f.shared("calls")
    old, new = relation_version(f, False), relation_version(f, True)
    state = relations_refresh.relation_state(**old)
    near = relations.ranked_neighbours(relations_refresh.dependencies(state))
    changes = {k: relations_refresh.signed_changes(old[k], new[k], new[k].columns) for k in new}
    state, touched = relations_refresh.refresh_relations(state, changes)
    near = relations_refresh.refresh_neighbours(near, state, touched)
    none = F.lit(None)
    row = lambda df, what, a, b, text, n, m: df.select(
        F.lit(what).alias("what"), a.alias("a"), b.cast("string").alias("b"), text.cast("string").alias("text"), n.cast("bigint").alias("n"), m.cast("bigint").alias("m"))
    c = F.col
    return (
        row(relations_refresh.dependencies(state), "dependency", c("from"), c("to"), c("kinds"), c("weight"), c("via_count"))
        .unionByName(row(state["links"], "link", c("a"), c("b"), none, none, none)).unionByName(row(near, "neighbour", c("module"), c("other"), c("role"), c("weight"), c("rank")))
        .unionByName(row(relations_refresh.build_stats(state), "build", c("module"), none, c("build_status"), c("compiled"), c("total"))))
