"""Aggregations, module facts and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.base import add
from codefacts.catalog.joins import INDIRECT_VIEW, indirect
from codefacts.catalog.rules import rules
from codefacts.operators import changes, decisions, hashes, modules, quality, relations, scope
from codefacts.projection import Facts
from codefacts.session import cut_lineage

CODE = "(path like '%.c' or path like '%.h')"
FP_SQL = """select project_id, substr(sha256(string_agg(concat(b,':',h), ',' order by b)),1,8) as fingerprint, 'tree' as algorithm from (
 select project_id, substr(sha256({k}),1,3) as b, sha256(string_agg(sha256(concat({k},'|',{v})), '' order by sha256(concat({k},'|',{v})))) as h from {t} group by 1, 2) group by project_id"""


def src_rules(f: Facts):
    """Each source ignores its German texts and has one library folder."""
    docs = f.table("documents").select(F.col("source").alias("project_id")).distinct()
    ig = docs.select("project_id", F.lit("ignore").alias("kind"), F.lit(1).alias("ord"), F.concat("project_id", F.lit("/de/**")).alias("pattern"), F.lit(None).cast("string").alias("name"))
    tp = docs.select("project_id", F.lit("third_party").alias("kind"), F.lit(2).alias("ord"), F.concat("project_id", F.lit("/es")).alias("pattern"), F.lit("es-lib").alias("name"))
    return ig.unionByName(tp)


@add("a1_project_fingerprint", FP_SQL.format(k="path", v="sha256(text)", t="docall where path not like concat(project_id,'/de/%')"))
def a1(f: Facts):
    return hashes.project_fingerprint(f.sources, src_rules(f))


@add("a2_source_fingerprint", FP_SQL.format(k="path", v="sha256(text)", t="docall"))
def a2(f: Facts):
    return hashes.source_fingerprint(f.sources)


@add("a3_scope_fingerprint", """
select project_id, substr(sha256(concat('{"build_target": "', project_id, '-main", "ignore": ["', project_id, '/de/**"], "project_include": [], "project_include_set": false, "third_party": ["',
 project_id, '/es|es-lib"]}')),1,8) as fingerprint from (select distinct source as project_id from documents)""")
def a3(f: Facts):
    r = src_rules(f)
    targets = r.select("project_id", F.concat("project_id", F.lit("-main")).alias("build_target")).distinct()
    return hashes.scope_fingerprint(r, targets)


def brand_build(f: Facts):
    """One build per brand: its files, compiled unless the part is large."""
    return f.symbols.join(f.table("part").select(F.col("p_partkey").alias("ord"), "p_size"), "ord").groupBy(
        F.col("module").alias("project_id"), F.col("file").alias("path")).agg((F.min("p_size") < 40).alias("compiled"))


def brand_builds(f: Facts):
    d = F.array(F.lit("DEBUG"), F.concat(F.lit("STM32_"), "project_id"))
    return f.symbols.select(F.col("module").alias("project_id")).distinct().select(
        "project_id", F.lit("keil").alias("system"), F.concat("project_id", F.lit("-t")).alias("target"), F.lit('x CPUTYPE("Cortex-M4")').alias("cpu"),
        d.alias("defines"), F.lit(True).alias("resolved"))


BRAND = {"bb": "select module as project_id, file as path, min(p_size) < 40 as compiled from sym join part on p_partkey=ord group by module, file"}


@add("a4_build_fingerprint", f"""select project_id, substr(sha256(concat(project_id, '-t|', fingerprint)),1,8) as fingerprint, algorithm
 from ({FP_SQL.format(k="path", v="case when compiled then 'true' else 'false' end", t="bb")})""", BRAND)
def a4(f: Facts):
    return hashes.build_fingerprint(brand_build(f), brand_builds(f))


@add("a5_content_hash", "select project_id, path, substr(sha256(text),1,16) as content_hash from docall")
def a5(f: Facts):
    return hashes.file_hashes(f.sources)


@add("a5_config_hashes", "select source as project_id, concat(lang, cast(doc_id as varchar), '.uvprojx') as name, substr(sha256(text),1,16) as content_hash from documents where lang='en'")
def a5c(f: Facts):
    name = F.concat("lang", F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".uvprojx").otherwise(".txt"))
    return hashes.config_hashes(f.table("documents").select(F.col("source").alias("project_id"), name.alias("path"), "text"))


@add("a6_struct_usage", """
select distinct concat(lower(p_type),'_f',cast(p_partkey % 50 as varchar)) as field, case when l_returnflag='R' then '(top-level)' else s.name end as function,
 case when l_linestatus='F' then 'write' else 'read' end as access from lineitem join part on p_partkey=l_partkey join sym s on s.ord=l_suppkey""")
def a6(f: Facts):
    part = f.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lower("p_type"), F.lit("_f"), (F.col("p_partkey") % 50).cast("string")).alias("field"))
    fn = f.symbols.select(F.col("ord").alias("l_suppkey"), "name")
    rows = f.table("lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag").join(part, "l_partkey").join(fn, "l_suppkey").select(
        F.lit("firmware").alias("project_id"), "field", F.when(F.col("l_returnflag") != "R", F.col("name")).alias("function"),
        F.when(F.col("l_linestatus") == "F", "write").otherwise("read").alias("access"))
    return changes.struct_usage(rows).drop("project_id")


@add("a7_symbol_prefixes", "select module, lower(split_part(name,'_',1)) as token, count(*) as n, min(ord) as first from sym group by all")
def a7(f: Facts):
    return modules.symbol_prefixes(f.symbols, ["module"])


PREFIX = """select {k}, token as prefix from (select {k}, token, n, sum(n) over (partition by {k}) as total, row_number() over (partition by {k} order by n desc, f) as rn from (
 select {k}, lower(split_part(name,'_',1)) as token, count(*) as n, min(ord) as f from sym group by all)) where rn=1 and n >= {m} and n/total >= 0.5"""


@add("a8_strong_prefix", PREFIX.format(k="file", m=2))
def a8(f: Facts):
    return modules.top_prefix(f.symbols, ["file"], 2)


@add("a8_file_prefix", PREFIX.format(k="file", m=1))
def a8f(f: Facts):
    return modules.top_prefix(f.symbols, ["file"], 1)


@add("a9_symbol_prefix_family", """
select file, sum(n) >= 3 and max(n) >= 3 and max(n)/sum(n) >= 0.5 as family from (select file, lower(split_part(name,'_',1)) as token, count(*) as n from sym group by all) group by file""")
def a9(f: Facts):
    return modules.prefix_family(f.symbols, ["file"])


VIA = {
    "via": """select m1 as "from", m2 as "to", kind, via, cast(sum(w) as bigint) as weight from (
      select a.module as m1, b.module as m2, 'call' as kind, callee as via, 3 + case when confidence='high' then 1 else 0 end as w from calls c
        join sym a on a.name=c.caller join sym b on b.name=c.callee where a.module <> b.module
      union all select a.module, b.module, 'include', target, 2 from includes i join (select file, max(module) as module from sym group by file) a on a.file=i.src
        join (select file, max(module) as module from sym group by file) b on b.file=i.target where a.module <> b.module) group by all""",
    "deps": """select "from", "to", cast(sum(weight) as bigint) as weight, case when bool_or(kind='call') and bool_or(kind='include') then 'call,include' when bool_or(kind='call') then 'call' else 'include' end as kinds,
      count(distinct via) as via_count from via group by all""",
    "ents": """select module, name, outside_calls, rank from (select s.module, s.name, count(*) as outside_calls, row_number() over (partition by s.module order by count(*) desc, s.ord) as rank from calls c
      join sym s on s.name=c.callee join sym a on a.name=c.caller where a.module <> s.module
      and not exists (select 1 from calls d join sym e on e.name=d.callee where d.caller=s.name and e.module=s.module) group by s.module, s.name, s.ord) where rank <= 3""",
    "facts": """select m.module, (select count(*) from sym s where s.module=m.module) as n_symbols, (select count(distinct file) from sym s where s.module=m.module) as n_files,
      (select count(*) from deps d where d."from"=m.module) as n_dependencies, (select count(*) from deps d where d."to"=m.module) as n_consumers,
      (select count(*) from ents e where e.module=m.module) as n_entries from (select distinct module from sym) m""",
}


def msyms(f: Facts):
    return f.symbols.select("project_id", "module", "name", "ord")


def mfiles(f: Facts):
    return f.symbols.select("project_id", "module", F.col("file").alias("path")).distinct()


def mods(f: Facts):
    return f.symbols.select("project_id", "module").distinct()


def via(f: Facts):
    f.shared_calls()
    return relations.dependency_via(f.calls, f.includes, msyms(f), mfiles(f))


def deps(f: Facts):
    return relations.module_dependencies(via(f))


def entries(f: Facts):
    return relations.entry_points(f.calls, msyms(f))


def facts(f: Facts):
    links = cut_lineage(deps(f))  # first, as it writes the calls
    return relations.module_facts(mods(f), msyms(f), mfiles(f), links, entries(f))


@add("a10_module_dependencies", "select * from deps", VIA)
def a10(f: Facts):
    f.fine_shuffles()
    return deps(f).drop("project_id")


@add("a10_dependency_via", "select * from via", VIA)
def a10v(f: Facts):
    f.fine_shuffles()
    return via(f).drop("project_id")


@add("a11_module_neighbours", """
select * from (select module, role, other, weight, cast(row_number() over (partition by module, role order by weight desc, other) as integer) as rank from (
 select "from" as module, 'dependency' as role, "to" as other, weight from deps union all select "to", 'consumer', "from", weight from deps)) where rank <= 10""", VIA)
def a11(f: Facts):
    return relations.ranked_neighbours(deps(f)).drop("project_id")


@add("a12_module_build_status", """
select s.module, ['compiled','not_compiled','excluded'][min(case compile_status when 'compiled' then 1 when 'not_compiled' then 2 else 3 end)] as build_status,
 count(*) filter (where compile_status='compiled') as compiled, count(*) as total from (select distinct module, file from sym) s join files f on f.path=s.file group by s.module""")
def a12(f: Facts):
    return relations.build_stats(mfiles(f), f.files).drop("project_id")


@add("a13_quality_report", """
select project_id, f as functions, fs as functions_with_signature, s as structs, sm as structs_with_members, e as enums, em as enums_with_values, m as macros, 25 as modules, r as rejected_tokens,
 case when least(fs/f, sm/s, em/e) >= 0.95 then 'A' when least(fs/f, sm/s, em/e) >= 0.85 then 'A-' when least(fs/f, sm/s, em/e) >= 0.7 then 'B+' when least(fs/f, sm/s, em/e) >= 0.5 then 'B' else 'C' end as grade
from (select project_id, count(*) filter (where type='function') as f, count(*) filter (where type='function' and start_line > 5) as fs, count(*) filter (where type='struct') as s,
 count(*) filter (where type='struct' and start_line > 8) as sm, count(*) filter (where type='enum') as e, count(*) filter (where type='enum' and start_line > 8) as em,
 count(*) filter (where type='macro' and start_line > 8) as m, count(*) filter (where not regexp_full_match(lower(split_part(name,'_',1)),'[a-z0-9]+')) as r from sym group by project_id)
""".replace("25 as modules", "(select count(distinct module) from sym) as modules"))
def a13(f: Facts):
    line = F.col("start_line")
    s = f.symbols.select("project_id", "name", "type", (line > 5).alias("has_signature"), (line > 8).alias("has_members"), (line > 8).alias("has_value"))
    caps = f.symbols.groupBy("project_id").agg(F.lit(True).alias("semantic"))
    return quality.quality_report(s, mods(f), caps)


@add("a14_scope_report", """
select scope_type, null as library, cast(sum(files) as bigint) as files, cast(sum(symbols) as bigint) as symbols, cast(sum(modules) as bigint) as modules, scope_type='third_party' and sum(modules) > count(lib) as overflow from per group by scope_type
union all select scope_type, lib, cast(files as bigint), cast(symbols as bigint), cast(modules as bigint), false from per where lib is not null""", {
    "fl": "select *, case when scope_type='third_party' then split_part(path,'/',1) end as lib from files",
    "sl": "select s.*, f.scope_type, case when f.scope_type='third_party' then split_part(s.file,'/',1) end as lib from sym s join files f on f.path=s.file",
    "per": """select scope_type, lib, sum(f) as files, sum(s) as symbols, sum(m) as modules from (select scope_type, lib, 1 as f, 0 as s, 0 as m from fl union all select scope_type, lib, 0, 1, 0 from sl
      union all select 'project', null, 0, 0, 1 from (select distinct module from sym)) group by all""",
})
def a14(f: Facts):
    files = f.files.withColumn("scope_name", F.lit(None).cast("string"))
    s = f.symbols.join(files.select("project_id", F.col("path").alias("file"), "scope_type", "scope_name"), ["project_id", "file"])
    return quality.scope_report(files, s, mods(f).withColumn("scope_type", F.lit("project"))).drop("project_id")


@add("a15_build_status", """
select project_id, 'valid' as build_status, 'keil' as system, concat(project_id,'-t') as target, count(*) filter (where compiled) as compiled_count,
 count(*) filter (where not compiled) as excluded_count, cast(2 as integer) as defines from bb group by project_id""", BRAND)
def a15(f: Facts):
    return quality.build_status(brand_build(f), brand_builds(f))


@add("a16_overview_facts", """
select 'firmware' as project_id, 'keil' as system, 'main' as target, 'Cortex-M4' as cpu, 'STM32F4' as chip, (select count(*) from files) as file_count, (select count(*) from sym) as symbol_count,
 (select count(*) from calls) as call_edge_count, (select count(*) from indirect) as indirect_call_count, (select count(distinct module) from sym) as module_count,
 (select count(*) from files where compile_status='compiled') as compiled_count, cast(null as varchar) as rtos""", INDIRECT_VIEW)
def a16(f: Facts):
    build = f.files.where("compile_status in ('compiled','excluded')").select("project_id", "path", (F.col("compile_status") == "compiled").alias("compiled"))
    return quality.overview_facts(f.files, f.symbols, f.calls, indirect(f), mods(f), build, one_build(f))


def one_build(f: Facts):
    return f.files.groupBy("project_id").agg(
        F.lit("keil").alias("system"), F.lit("main").alias("target"), F.lit('CPUTYPE("Cortex-M4")').alias("cpu"), F.array(F.lit("USE_HAL"), F.lit("STM32F4")).alias("defines"))


@add("a17_indirect_areas", """
select file, via, min(callee) as callee, count(*) as n from indirect group by file, via""", INDIRECT_VIEW)
def a17(f: Facts):
    return indirect(f).groupBy("file", "via").agg(F.min("callee").alias("callee"), F.count("*").alias("n"))


@add("a17_architecture_modules", """
select f.module, n_symbols, n_files, n_dependencies, n_consumers, n_entries, case when (n_entries>=2 and n_consumers>=1 and n_dependencies>=1) or (n_entries>=3 and (n_consumers>=1 or n_dependencies>=1)) or
 (n_entries>=1 and n_consumers>=2 and n_dependencies>=1) or (n_entries>=1 and n_dependencies>=2 and n_symbols>=10) or (n_entries>=1 and (n_consumers>=1 or n_dependencies>=1) and fam and n_symbols>=10)
 or (n_entries=0 and n_dependencies>=3 and n_consumers>=1 and n_symbols>=10) then 'high' when n_entries>=1 or n_consumers>=1 or n_dependencies>=1 then 'medium' else 'low' end as score
from facts f join fam on fam.module=f.module""", {**VIA, "fam": "select module, sum(n) >= 3 and max(n) >= 3 and max(n)/sum(n) >= 0.5 as fam from (select module, split_part(name,'_',1) as t, count(*) as n from sym group by all) group by module"})
def a17m(f: Facts):
    fam = modules.prefix_family(f.symbols, ["project_id", "module"])
    return modules.score_module(facts(f).join(fam, ["project_id", "module"])).drop("project_id", "family")


@add("a18_allow_list", """
select distinct upper(n) as name from (select module as n from sym union all select name from sym union all select regexp_extract(file,'[^/]+$') from sym
 union all select unnest(['MAIN','CPUTYPE','USE_HAL','STM32F4'])) where length(n) >= 2""")
def a18(f: Facts):
    return quality.allow_list(mods(f), msyms(f), mfiles(f), deps(f), one_build(f), f.symbols).select("name")


@add("a19_suggest_scopes", """
select source as project_id, 'ignore' as kind, 'tools' as path, 'name' as reason from lt where lang='en' and not (py/n > 0.8 and py >= 2)
union all select source, 'ignore', case lang when 'en' then 'tools' when 'fr' then 'docsrc' when 'de' then 'Middlewares' else 'app' end, 'python_tools' from lt where py/n > 0.8 and py >= 2
union all select source, 'third_party', 'Middlewares/lvgl', 'library_dir' from lt where lang='de'""", {
    "lt": "select source, case when lang in ('en','fr','de') then lang else 'xx' end as lang, count(*) as n, count(*) filter (where n_chars % 10 <> 0) as py from documents group by all"})
def a19(f: Facts):
    lang = F.col("lang")
    d = F.when(lang == "en", "tools").when(lang == "fr", "docsrc").when(lang == "de", "Middlewares/lvgl").otherwise("app")
    path = F.concat(d, F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") % 10 != 0, ".py").otherwise(".c"))
    files = f.table("documents").select(F.col("source").alias("project_id"), path.alias("path"))
    cpus = f.table("documents").select(F.col("source").alias("project_id"), F.lit("").alias("dir"), F.lit("M4").alias("cpu")).distinct()
    return scope.suggest_scopes(files, cpus)


@add("a21_open_findings", """
select task_id, seq as finding_id, case when type='FindingCreated' and floor(value / 50) < mx then 'RESOLVED' when type='FindingCreated' then 'OPEN' else 'REJECTED' end as status
from (select *, max(floor(value / 50)) over (partition by task_id) as mx from ev where type in ('FindingCreated','TestFinished'))""")
def a21(f: Facts):
    rows = f.events.where("type in ('FindingCreated','TestFinished')").select(
        "project_id", "task_id", F.col("seq").alias("finding_id"), F.floor(F.col("value") / 50).alias("round"),
        F.when(F.col("type") == "FindingCreated", "OPEN").otherwise("REJECTED").alias("status"))
    return decisions.open_findings(rows).select("task_id", "finding_id", "status")


@add("a22_ignored_top_dirs", "select distinct module as project_id, lower(p_type) as dir from sym join part on p_partkey=ord")
def a22(f: Facts):
    part = f.table("part").select(F.col("p_partkey").alias("ord"), F.lower("p_type").alias("t"))
    r = f.symbols.join(part, "ord").select(F.col("module").alias("project_id"), F.lit("ignore").alias("kind"), "ord",
                                           F.explode(F.array(F.concat(F.lit("/"), "t", F.lit("/")), F.col("file"))).alias("pattern"), F.lit(None).cast("string").alias("name"))
    return scope.ignored_top_dirs(r)


@add("a22_count_source_files", "select project_id, count(*) as n from docall group by project_id")
def a22c(f: Facts):
    return scope.count_source_files(f.sources, "_index")


@add("w3_entry_points", "select module, name, outside_calls, cast(rank as integer) as rank from ents", VIA)
def w3(f: Facts):
    return entries(f).select("module", "name", "outside_calls", "rank")


ENTRY_SQL = """
select file, symbol, arg_min(reason, ord) as reason, arg_min(confidence, ord) as confidence from (
 select ord, file, name as symbol, 'contains main function' as reason, 'high' as confidence from ws where name='main'
 union all select ord, file, name, 'RTOS scheduler start', case when regexp_extract(file,'[^/]+$') in (select regexp_extract(path,'[^/]+$') from files where compile_status='compiled') then 'high' else 'medium' end from ws where name='vTaskStartScheduler'
 union all select c.ord, s.file, s.name, 'creates task via xTaskCreate', 'medium' from (select distinct caller, callee from wc) w join ws c on c.name='xTaskCreate' and w.callee='xTaskCreate'
   join (select name, arg_min(file, ord) as file from ws group by name) s on s.name=w.caller) group by file, symbol"""
ENTRY_VIEWS = {"ws": "select ord, file, case when start_line=50 then 'main' when start_line=49 then 'vTaskStartScheduler' when ord=(select max(p_partkey) from part) then 'xTaskCreate' else name end as name, name as old from sym",
      "wc": "select a.name as caller, b.name as callee from calls c join ws a on a.old=c.caller join ws b on b.old=c.callee"}


def candidates(f: Facts):
    last = f.table("part").agg(F.max("p_partkey").alias("mx"))
    s = f.symbols.join(last, F.col("ord") == F.col("mx"), "left")
    name = F.when(F.col("start_line") == 50, "main").when(F.col("start_line") == 49, "vTaskStartScheduler").when(F.col("mx").isNotNull(), "xTaskCreate").otherwise(F.col("name"))
    ws = s.select("project_id", "ord", "file", "type", "start_line", name.alias("name"), F.col("name").alias("old"))
    a = ws.select("project_id", F.col("old").alias("caller"), F.col("name").alias("c1"))
    b = ws.select("project_id", F.col("old").alias("callee"), F.col("name").alias("c2"))
    wc = f.calls.select("project_id", "caller", "callee").join(a, ["project_id", "caller"]).join(b, ["project_id", "callee"]).select("project_id", F.col("c1").alias("caller"), F.col("c2").alias("callee"))
    out = quality.entry_candidates(ws, wc, f.files.where("compile_status = 'compiled'"))
    return out


@add("w4_entry_candidates", ENTRY_SQL, ENTRY_VIEWS)
def w4(f: Facts):
    return candidates(f).select("file", "symbol", "reason", "confidence")


CHG = {"chg": """select coalesce(o.project_id,n.project_id) as project_id, coalesce(o.path,n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' else 'modified' end as change
  from docold o full outer join docnew n on n.project_id=o.project_id and n.path=o.path where o.path is null or n.path is null or o.text <> n.text"""}


def chg(f: Facts):
    old, new = f.file_versions
    return changes.file_changes(hashes.file_hashes(old), hashes.file_hashes(new))


@add("u1_classify_file_changes", "select * from chg", CHG)
def u1(f: Facts):
    return chg(f)


@add("u1_change_level", """
select p.project_id, case when c.n is null then 'L0' else 'L3' end as level, coalesce(m,0) as modified, coalesce(a,0) as added, coalesce(r,0) as removed from (select distinct source as project_id from documents) p left join
 (select project_id, count(*) as n, count(*) filter (where change='modified') as m, count(*) filter (where change='added') as a, count(*) filter (where change='removed') as r from chg group by project_id) c on c.project_id=p.project_id""", CHG)
def u1l(f: Facts):
    return changes.change_level(chg(f), f.table("documents").select(F.col("source").alias("project_id")))


@add("q18_classify_source_change", """
select p.project_id, coalesce(n,0) as changed_files, coalesce(h,0) as high_risk, case when coalesce(n,0)=0 then 'VALID' when n > 20 or h > 5 then 'REINDEX_REQUIRED' else 'STALE_RECOMMENDED' end as state
 from (select distinct source as project_id from documents) p left join (select project_id, count(*) as n, count(*) filter (where path like '%.h' and regexp_matches(lower(regexp_extract(path,'[^/]+$')),'config|types|typedef|common|defs|hal|port')) as h from chg group by project_id) c on c.project_id=p.project_id""", CHG)
def q18(f: Facts):
    return changes.classify_source_change(chg(f), f.table("documents").select(F.col("source").alias("project_id")), {"source_large_files": 20})


OLDNEW = {"oldsym": "select ord, project_id, name, file, type, 'old' as version from sym",
          "newsym": "select ord, project_id, case when ord % 3=0 then concat(name,'_v2') else name end as name, file, type, 'new' as version from sym where ord % 5 <> 4 or start_line > 30"}


def _versions(f: Facts):
    old = f.symbols.select("ord", "project_id", "name", "file", "type", F.lit("old").alias("version"))
    k = F.col("ord")
    new = f.symbols.where((k % 5 != 4) | (F.col("start_line") > 30)).select(
        "ord", "project_id", F.when(k % 3 == 0, F.concat("name", F.lit("_v2"))).otherwise(F.col("name")).alias("name"), "file", "type", F.lit("new").alias("version"))
    changed = f.files.where("compile_status = 'excluded'").select("project_id", "path")
    return old, new, changed


@add("u2_merge_symbols_incremental", """
select name, file, type, ord, version from oldsym where file not in (select path from files where compile_status='excluded') union all
select name, file, type, ord, version from newsym where file in (select path from files where compile_status='excluded')""", OLDNEW)
def u2(f: Facts):
    return changes.merge_symbols(*_versions(f)).drop("project_id")


@add("u3_patch_type_facts", """
select name, file, type, version from oldsym where type <> 'function' and file not in (select path from files where compile_status='excluded') union
select name, file, type, version from newsym where type <> 'function' and file in (select path from files where compile_status='excluded')""", OLDNEW)
def u3(f: Facts):
    old, new, changed = _versions(f)
    return changes.patch_facts(old.drop("ord").where("type <> 'function'"), new.drop("ord").where("type <> 'function'"), changed).drop("project_id")


@add("u4_reuse_by_hash", """
select s.name, s.file, s.type, case when s.start_line > 25 then 'old' else 'new' end as facts, s.start_line > 25 as reused from sym s where type <> 'function'""")
def u4(f: Facts):
    rows = f.symbols.where("type <> 'function'")
    old = rows.select("project_id", "file", "name", F.sha2("name", 256).alias("content_hash"), F.lit("old").alias("facts"))
    new = rows.select("project_id", "file", "name", "type", F.sha2(F.when(F.col("start_line") > 25, F.col("name")).otherwise(F.concat("name", F.lit("2"))), 256).alias("content_hash"), F.lit("new").alias("facts"))
    return changes.reuse_by_hash(old, new, ["facts"]).select("name", "file", "type", "facts", "reused")


@add("u5_candidate_files", """
select coalesce(g.path, d.path) as path, case when g.path is not null then 'active' else 'orphaned' end as status from (select distinct path from docold) g full outer join (select distinct path from docnew) d on d.path=g.path""")
def u5(f: Facts):
    old, new = f.file_versions
    return changes.file_universe(old, new).select("path", "status")


@add("g9_modules_linked", """
select distinct least(m1,m2) as a, greatest(m1,m2) as b from (select "from" as m1, "to" as m2 from via)""", VIA)
def g9(f: Facts):
    return relations.module_links(f.calls, f.includes, msyms(f), mfiles(f)).select("a", "b")


@add("q11_score_module", """
select module, n_symbols, n_entries from facts""", VIA)
def q11(f: Facts):
    return facts(f).select("module", "n_symbols", "n_entries")


@add("q11_module_evidence", """
select module, concat('entry_point:',name) as evidence from ents union all select module, concat('symbol:',name) from (select *, row_number() over (partition by module order by ord) as rn from sym) where rn <= 10
union all select module, concat(role,':',other) from (select *, row_number() over (partition by module, role order by weight desc, other) as rn from (
 select "from" as module, 'dependency' as role, "to" as other, weight from deps union all select "to", 'consumer', "from", weight from deps)) where rn <= 10
union all select module, concat('path:',min(split_part(file,'/',1))) from sym group by module""", VIA)
def q11e(f: Facts):
    links = cut_lineage(deps(f))
    return modules.module_evidence(entries(f), msyms(f), relations.ranked_neighbours(links), mfiles(f)).select("module", "evidence")


@add("q12_entry_status", """
select m.module, case when m.module='Brand_1' then 'missing' when exists (select 1 from sym s where s.module=m.module and s.start_line=50) then 'stale' else 'valid' end as status from (select distinct module from sym) m""")
def q12(f: Facts):
    links = cut_lineage(deps(f))
    tops = cut_lineage(entries(f))
    now = modules.snapshot_of(tops, links, msyms(f), mods(f))
    fewer = f.symbols.where("start_line <> 50").select("project_id", "module", "name", "ord")
    old = modules.snapshot_of(tops, links, fewer, mods(f)).where("module <> 'Brand_1'")
    return modules.entry_status(now, old).select("module", "status")


@add("q13_fallback_responsibility", """
select f.module, concat('包含 ', case when n_entries>0 then concat(n_entries,' 个入口接口、') else '' end, case when n_symbols>0 then concat(n_symbols,' 个符号、') else '' end,
 case when n_entries>0 or n_symbols>0 then '的业务模块' else '模块' end, case when d.l is not null then concat('，依赖 [',d.l,']') else '' end, case when c.l is not null then concat('，被 [',c.l,'] 调用') else '' end) as responsibility
from facts f left join (select module, string_agg(other, ', ' order by weight desc, other) as l from (select "from" as module, "to" as other, weight, row_number() over (partition by "from" order by weight desc, "to") as rn from deps) where rn<=5 group by module) d on d.module=f.module
left join (select module, string_agg(other, ', ' order by weight desc, other) as l from (select "to" as module, "from" as other, weight, row_number() over (partition by "to" order by weight desc, "from") as rn from deps) where rn<=5 group by module) c on c.module=f.module""", VIA)
def q13(f: Facts):
    links = cut_lineage(deps(f))
    known = relations.module_facts(mods(f), msyms(f), mfiles(f), links, entries(f))
    return modules.fallback_responsibility(known, relations.ranked_neighbours(links)).select("module", "responsibility")


@add("q13_planning_view", """
select module, concat(module,': does ',module, case when n % 3=0 then ' [职责置信度=high]' else ' [职责置信度=medium]（推断）' end) as line from (select module, count(*) as n from sym group by module) where n % 3 < 2""")
def q13p(f: Facts):
    n = f.symbols.groupBy("project_id", "module").agg(F.count("*").alias("n"))
    conf = F.when(F.col("n") % 3 == 0, "high").when(F.col("n") % 3 == 1, "medium").otherwise("low")
    return modules.planning_view(n.select("project_id", "module", F.concat(F.lit("does "), "module").alias("responsibility"), conf.alias("confidence"), F.lit("llm").alias("generated_by"))).select("module", "line")


def discovery(f: Facts):
    """Discovery over the projected tables; a tenth of the symbol types stands in build groups."""
    files = f.files.withColumn("scope_name", F.when(F.col("scope_type") == "third_party", F.lit("LVGL")))
    groups = f.files.where("compile_status = 'excluded'").select("project_id", "path", F.concat(F.lit("G_"), F.substring_index(F.substring_index("path", "/", -1), "_", 1)).alias("group"))
    return modules.discover_modules(files, f.symbols, groups, f.calls, f.includes)


@add("g8_discover_modules")
def g8(f: Facts):
    return discovery(f).modules.drop("project_id")


@add("g8_module_files")
def g8f(f: Facts):
    return discovery(f).files.select("module_id", "module", "path")


@add("g8_module_symbols")
def g8s(f: Facts):
    return discovery(f).symbols.select("module_id", "module", "name")
