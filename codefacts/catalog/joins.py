"""Joins and name lookups over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.base import SQL, add
from codefacts.catalog.rules import rules
from codefacts.catalog.scalars import SCOPE_SQL

from codefacts.operators import callgraph, decisions, lookups, scope
from codefacts.projection import Facts

SYM_SCOPE = SCOPE_SQL.format(p="file")


def asked_names(f: Facts):
    """One asked name per customer: the exact name, another case, an inner part or something unknown."""
    k = F.col("ord")
    name = F.col("name")
    ask = (
        F.when(k % 4 == 0, name).when(k % 4 == 1, F.upper("name")).when(k % 4 == 2, F.substring_index("name", "_", -2))
        .otherwise(F.concat(F.lit("zz_"), "name"))
    )
    return f.symbols.select("project_id", ask.alias("ask"))


ASKED = {
    "asked": """select distinct case ord % 4 when 0 then name when 1 then upper(name)
      when 2 then array_to_string(string_split(name,'_')[-2:],'_') else concat('zz_',name) end as ask from sym"""
}

MATCH_SQL = """select ask, tier, ord, name from (select ask, tier, ord, name, row_number() over (partition by ask order by tier, ord) as rn from (
  select ask, case when ask = name then 0 when lower(ask) = lower(name) then 1 else 2 end as tier, ord, name
  from asked join {t} on contains(lower(name), lower(ask)))) where rn=1"""


@add("w1_match_symbol", MATCH_SQL.format(t="sym"), ASKED)
def w1(f: Facts):
    return lookups.match_name(asked_names(f), f.symbols, "name").select("ask", "tier", "ord", "name")


@add("w2_match_module", """select ask, module from (select ask, module, row_number() over (partition by ask order by tier, ord) as rn from (
  select ask, case when lower(ask) = lower(module) then 0 else 1 end as tier, ord, module from
  (select distinct case when p_size % 2 = 0 then upper(replace(p_brand,'#','_')) else substr(p_brand, 4) end as ask from part) q
  join (select module, min(ord) as ord from sym group by module) m on contains(lower(module), lower(replace(ask,'#','_'))))) where rn=1""")
def w2(f: Facts):
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    ask = F.when(F.col("p_size") % 2 == 0, F.upper(brand)).otherwise(F.substr("p_brand", F.lit(4)))
    asked = f.table("part").select(F.lit("firmware").alias("project_id"), ask.alias("a")).distinct()
    clean = asked.select("project_id", F.replace("a", F.lit("#"), F.lit("_")).alias("ask"), F.col("a").alias("orig"))
    mods = f.symbols.groupBy("project_id", "module").agg(F.min("ord").alias("ord"))
    hit = lookups.match_name(clean, mods, "module")
    return clean.join(hit, ["project_id", "ask"]).select(F.col("orig").alias("ask"), "module")


@add("j1_call_edges", f"""
with_calls""".replace("with_calls", f"""
select s.project_id, s.name as caller, t.name as callee, case when e.score is null then 'medium' when e.score>=0.8 then 'high' when e.score>=0.5 then 'medium' else 'low' end as confidence,
 e.score as confidence_score, s.file as file, e.line as line, (s.sc='third_party' or t.sc='third_party') as external
from (select source, target, line, try_cast(json_extract_string(metadata,'$.confidence') as double) as score from edges where kind='calls') e
join scoped s on s.id=e.source join scoped t on t.id=e.target
where s.sc<>'ignored' and t.sc<>'ignored' and not (s.sc='third_party' and t.sc='third_party')"""),
     {"scoped": f"select project_id, concat('s',cast(ord as varchar)) as id, name, file, {SYM_SCOPE} as sc from sym"})
def j1(f: Facts):
    return callgraph.call_edges(f.nodes, f.edges, rules(f))


@add("j2_include_edges", f"""
select project_id, src, target from includes where {SCOPE_SQL.format(p='src')} <> 'ignored' and {SCOPE_SQL.format(p='target')} <> 'ignored'""")
def j2(f: Facts):
    return callgraph.include_edges(f.nodes, f.edges, rules(f))


@add("j3_merge_semantics", """
select coalesce(s.name, p.name) as name, coalesce(s.file, p.file) as file, coalesce(s.type, p.type) as type,
  case when s.name is null then true else false end as appended, coalesce(nullif(s.value,''), p.value) as value,
  p.name is not null as semantic
from (select name, file, type, case when ord % 6 = 0 then 'own' when ord % 6 = 1 then '' end as value from sym) s
full outer join (select case when ord % 3 = 2 then concat(name,'_new') else name end as name, file, type, concat('v',cast(ord as varchar)) as value
  from sym where type in ('macro','enum')) p on p.name=s.name and p.file=s.file and p.type=s.type""")
def j3(f: Facts):
    k = F.col("ord")
    own = f.symbols.withColumn("value", F.when(k % 6 == 0, "own").when(k % 6 == 1, ""))
    none = F.lit(None).cast("string")
    parsed = f.symbols.where(F.col("type").isin("macro", "enum")).select(
        "project_id", "ord", F.when(k % 3 == 2, F.concat("name", F.lit("_new"))).otherwise(F.col("name")).alias("name"), "file", "type",
        "start_line", "end_line", none.alias("signature"), none.alias("members"), F.concat(F.lit("v"), k.cast("string")).alias("value"),
        none.alias("value_expr"),
    )
    return callgraph.merge_semantics(own, parsed).select("name", "file", "type", "appended", "value", "semantic")


@add("j4_classify_scope", f"""
select path, compile_status, {SCOPE_SQL.format(p='path')} as scope_type, case when {SCOPE_SQL.format(p='path')}='third_party' then 'lvgl-lib' end as scope_name
from files where {SCOPE_SQL.format(p='path')} <> 'ignored'""")
def j4(f: Facts):
    return scope.classify_scope(f.files, rules(f)).select("path", "compile_status", "scope_type", "scope_name")


BOUNDARY = {
    "reach": """select path as node from files where compile_status='compiled'
      union select regexp_replace(path,'\\.[^./]+$','.h') from files where compile_status='compiled' and path like '%.c'
        and regexp_replace(path,'\\.[^./]+$','.h') in (select path from files)
      union select i.target from reach join includes i on i.src=reach.node""",
}


def _recursive(body: str) -> str:
    from codefacts.catalog.base import with_views

    return with_views(body, BOUNDARY).replace("with ", "with recursive ", 1).replace("reach as materialized", "reach(node) as")


def boundary(f: Facts):
    compiled = f.files.where("compile_status = 'compiled'")
    return scope.build_boundary(compiled.select("project_id", "path"), f.includes, f.files.select("project_id", "path"))


@add("g1_build_boundary")
def g1(f: Facts):
    return boundary(f).select("path")


SQL["j5_classify_build_scope"] = _recursive(f"""
select path, case when {SCOPE_SQL.format(p='path')} = 'third_party' then 'third_party' when path in (select node from reach) then 'project' else 'non_build' end as scope_type,
 case when {SCOPE_SQL.format(p='path')} = 'third_party' then 'lvgl-lib' end as scope_name from files where {SCOPE_SQL.format(p='path')} <> 'ignored'""")
SQL["g1_build_boundary"] = _recursive("select distinct node as path from reach")


@add("j5_classify_build_scope")
def j5(f: Facts):
    builds = f.files.groupBy("project_id").agg(F.lit(True).alias("resolved"))
    return scope.classify_build_scope(f.files, rules(f), boundary(f), builds).select("path", "scope_type", "scope_name")


INDIRECT = """select b.project_id, b.name as callee, via, file, line, min((caller_hint, field)) as f
  from bindings b where exists (select 1 from sym s where s.name=b.name and s.type='function') group by b.project_id, b.name, via, file, line"""
INDIRECT_VIEW = {"indirect": f"""select project_id, callee, via, file, line, f[1] as caller_hint, 'high' as confidence, f[2] as field from (
  select b.project_id, b.name as callee, b.via, b.file, b.line, min([b.caller_hint, b.field]) as f from bindings b
  where exists (select 1 from sym s where s.name=b.name and s.type='function') group by all)"""}


def indirect(f: Facts):
    return callgraph.filter_indirect_calls(f.bindings, f.symbols)


@add("j6_filter_indirect_calls", "select * from indirect", INDIRECT_VIEW)
def j6(f: Facts):
    return indirect(f)


@add("j7_registered_callbacks", """
select distinct s.struct, s.field, s.file, i.callee as registered from struct_fields s join indirect i on i.via='field_assign' and i.field=s.field
 and replace(replace(regexp_extract(i.file,'[^/]+$'),'.c',''),'.h','') = replace(replace(regexp_extract(s.file,'[^/]+$'),'.c',''),'.h','')""", INDIRECT_VIEW)
def j7(f: Facts):
    return callgraph.registered_callbacks(f.struct_fields, indirect(f)).select("struct", "field", "file", "registered")


@add("j8_group_file_match", """
select a.ask, case when e.path is not null then e.path when s.n=1 then s.p when b.n=1 then b.p end as path,
  case when e.path is not null then 'exact' when s.n=1 then 'suffix' when b.n=1 then 'base' end as match
from ga a left join files e on e.path=a.ask
left join (select ask, count(*) as n, min(path) as p from ga join files on ends_with(path, concat('/',ask)) group by ask) s on s.ask=a.ask
left join (select regexp_extract(path,'[^/]+$') as base, count(*) as n, min(path) as p from files group by 1) b on b.base=regexp_extract(a.ask,'[^/]+$')""",
     {"ga": """select distinct case ord % 3 when 0 then file when 1 then array_to_string(string_split(file,'/')[-2:],'/') else concat('other/',regexp_extract(file,'[^/]+$')) end as ask from sym"""})
def j8(f: Facts):
    k = F.col("ord")
    ask = F.when(k % 3 == 0, F.col("file")).when(k % 3 == 1, F.substring_index("file", "/", -2)).otherwise(F.concat(F.lit("other/"), F.substring_index("file", "/", -1)))
    return scope.unique_match(f.symbols.select("project_id", ask.alias("ask")), f.files).select("ask", "path", "match")


@add("j9_module_of_file", """
select a.path, coalesce(e.module, case when b.lo=b.hi then b.lo end) as module from
 (select distinct case when ord % 2 = 0 then path else concat('x/',regexp_extract(path,'[^/]+$')) end as path from files) a
 left join (select file, min(module) as module from sym group by file) e on e.file=a.path
 left join (select regexp_extract(file,'[^/]+$') as base, min(module) as lo, max(module) as hi from sym group by 1) b on b.base=regexp_extract(a.path,'[^/]+$')
 where coalesce(e.module, case when b.lo=b.hi then b.lo end) is not null""")
def j9(f: Facts):
    path = F.when(F.col("ord") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("x/"), F.substring_index("path", "/", -1)))
    mf = f.symbols.select("project_id", "module", F.col("file").alias("path")).distinct()
    return lookups.module_of_file(f.files.select("project_id", path.alias("path")), mf).select("path", "module")


@add("j10_module_of_symbol", "select c.caller as name, s.module as module, s.file as file from (select distinct caller from calls) c join sym s on s.name=c.caller")
def j10(f: Facts):
    names = f.calls.select("project_id", F.col("caller").alias("name")).distinct()
    mod = lookups.module_of_symbol(names, f.symbols.select("project_id", "name", "module"))
    first = lookups.first_by_name(f.symbols).select("project_id", "name", "file")
    return mod.join(first, ["project_id", "name"]).select("name", "module", "file")


@add("j11_enclosing_function", """
select p.file, p.line, max_by(s.name, s.start_line * 1000000 + s.ord * 0) as function from
 (select distinct file, line + 20 as line from calls) p left join (select file, name, ord, start_line, end_line from sym) s
 on s.file=p.file and p.line between s.start_line and s.end_line group by p.file, p.line""".replace(
    "max_by(s.name, s.start_line * 1000000 + s.ord * 0)", "max_by(s.name, concat(lpad(cast(s.start_line as varchar),9,'0'), s.name))"))
def j11(f: Facts):
    points = f.calls.select("project_id", "file", (F.col("line") + 20).alias("line")).distinct()
    return lookups.enclosing_function(points, f.symbols).select("file", "line", "function")


@add("j12_callers_callees", """
select 'caller' as role, callee as name, caller as other, file, line from calls union all
select 'callee', caller, callee, file, line from calls""")
def j12(f: Facts):
    names = f.symbols.select("project_id", "name")
    a = lookups.callers_of(names, f.calls).select(F.lit("caller").alias("role"), "name", F.col("caller").alias("other"), "file", "line")
    b = lookups.callees_of(names, f.calls).select(F.lit("callee").alias("role"), "name", F.col("callee").alias("other"), "file", "line")
    return a.unionByName(b)


@add("j12_caller_files", """
select name, caller_file, first_caller from (select callee as name, file as caller_file, caller as first_caller,
 row_number() over (partition by callee, file order by line, caller) as rn from calls) where rn=1""")
def j12f(f: Facts):
    f.fine_shuffles()
    return lookups.caller_files_of(f.symbols.select("project_id", "name"), f.calls, f.symbols).select("name", "caller_file", "first_caller")


ASK_FILES = """select distinct case ord % 3 when 0 then concat('./',upper(path)) when 1 then concat('lost/',regexp_extract(path,'[^/]+$')) else concat('none_',cast(ord as varchar)) end as ask from files"""


@add("j13_find_file", f"""
select a.ask, coalesce(e.path, t.path) as path, e.path is not null as exact from af a
left join (select lower(path) as p, max_by(path, ord) as path from files group by 1) e on e.p = lower(regexp_replace(a.ask,'^[./]+',''))
left join (select lower(regexp_extract(path,'[^/]+$')) as b, min_by(path, ord) as path from files where path like '%/%' group by 1) t
 on t.b = lower(regexp_extract(a.ask,'[^/]+$')) where coalesce(e.path,t.path) is not null""", {"af": ASK_FILES})
def j13(f: Facts):
    k = F.col("ord")
    ask = F.when(k % 3 == 0, F.concat(F.lit("./"), F.upper("path"))).when(k % 3 == 1, F.concat(F.lit("lost/"), F.substring_index("path", "/", -1))).otherwise(
        F.concat(F.lit("none_"), k.cast("string")))
    return lookups.find_file(f.files.select("project_id", ask.alias("ask")), f.files).select("ask", "path", "exact")


@add("j14_find_symbol", """
select a.ask, coalesce(s.type, t.type) as type, coalesce(s.file, t.file) as file, coalesce(s.start_line, t.line) as start_line from
 (select distinct case when ord % 2 = 0 then name else concat('T_',name) end as ask from sym) a
 left join sym s on s.name=a.ask left join (select concat('T_',name) as name, type, file, start_line as line from sym where type <> 'function') t on t.name=a.ask
 where coalesce(s.type,t.type) is not null""")
def j14(f: Facts):
    asked = f.symbols.select("project_id", F.when(F.col("ord") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("T_"), "name")).alias("ask"))
    types = f.symbols.where("type <> 'function'").select(
        "project_id", F.col("type").alias("kind"), F.concat(F.lit("T_"), "name").alias("name"), "ord", "file", F.col("start_line").alias("line"))
    return lookups.find_symbol(asked, f.symbols, types).select("ask", "type", "file", "start_line")


@add("j15_weak_symbol_match", """
select ask, name from (select a.ask, s.name, row_number() over (partition by a.ask order by s.ord) as rn from
 (select distinct case when ord % 2 = 0 then substr(name, 3) else concat('My', name) end as ask from sym) a join sym s
 on lower(s.name) <> lower(a.ask) and (ends_with(lower(s.name), lower(a.ask)) or ends_with(lower(a.ask), lower(s.name))) where length(a.ask) >= 4) where rn=1""")
def j15(f: Facts):
    ask = F.when(F.col("ord") % 2 == 0, F.substr("name", F.lit(3))).otherwise(F.concat(F.lit("My"), "name"))
    return lookups.weak_symbol_match(f.symbols.select("project_id", ask.alias("ask")), f.symbols).select("ask", "name")


@add("j16_struct_field_usage", """
select field, arg_min(struct, o) as struct, arg_min(file, o) as file, arg_min(line, o) as line, any_value(r) as readers, any_value(w) as writers from (
 select q.field, s.struct, s.file, s.line, s.ord * 10 + s.i as o, coalesce(u.r,0) as r, coalesce(u.w,0) as w from
  (select distinct field from field_usage union select distinct field from struct_fields) q left join struct_fields s on s.field=q.field
  left join (select field, count(*) filter (where access='read') as r, count(*) filter (where access='write') as w from field_usage group by field) u on u.field=q.field) group by field""")
def j16(f: Facts):
    asked = f.field_usage.select("project_id", "field").unionByName(f.struct_fields.select("project_id", "field")).distinct()
    return lookups.struct_field_usage(asked.withColumnRenamed("field", "ask"), f.struct_fields, f.field_usage).drop("project_id")


@add("j17_include_by", """
select distinct f.path, i.src from files f join (select distinct src, regexp_extract(target,'[^/]+$') as base from includes) i on i.base=regexp_extract(f.path,'[^/]+$')""")
def j17(f: Facts):
    return lookups.include_by(f.files, f.includes).select("path", "src")


@add("j19_build_query", """
select a.path, coalesce(c,false) or coalesce(x,false) as "exists", coalesce(c,false) and not coalesce(x,false) as compiled, coalesce(x,false) and not coalesce(c,false) as excluded,
 case when coalesce(c,false) and not coalesce(x,false) then 'compiled' when coalesce(x,false) then 'excluded' else 'not_in_project' end as status
from aq a left join (select a.path, bool_or(b.compile_status='compiled') as c, bool_or(b.compile_status<>'compiled') as x
 from aq a join files b on b.compile_status in ('compiled','excluded') and (contains(lower(b.path), lower(a.path)) or lower(b.path)=lower(regexp_extract(a.path,'[^/]+$'))) group by a.path) h on h.path=a.path""",
     {"aq": """select distinct case ord % 3 when 0 then path when 1 then array_to_string(string_split(path,'/')[-2:],'/') else concat('gone/',path) end as path from files"""})
def j19(f: Facts):
    k = F.col("ord")
    ask = F.when(k % 3 == 0, F.col("path")).when(k % 3 == 1, F.substring_index("path", "/", -2)).otherwise(F.concat(F.lit("gone/"), "path"))
    build = f.files.where(F.col("compile_status").isin("compiled", "excluded")).select("project_id", "path", (F.col("compile_status") == "compiled").alias("compiled"))
    return scope.build_query(f.files.select("project_id", ask.alias("path")), build).drop("project_id")


@add("j20_scope_preview", f"""
select path, {SCOPE_SQL.format(p='path')} as before, case when {SCOPE_SQL.format(p='path')} = 'ignored' then 'ignored' when path like 'App/Brand\\_2/%' escape '\\' then 'third_party' else
 {SCOPE_SQL.format(p='path')} end as after, {SCOPE_SQL.format(p='path')} <> 'ignored' and path like 'App/Brand\\_2/%' escape '\\' as moved from files""")
def j20(f: Facts):
    new = rules(f, [("firmware", "third_party", 4, "App/Brand_2", "b2")])
    return scope.scope_preview(f.files, rules(f), new).select("path", "before", "after", "moved")


@add("j21_drop_changed_facts", "select name, file, type from sym where file not in (select path from files where compile_status='excluded')")
def j21(f: Facts):
    return callgraph.drop_changed_facts(f.symbols, f.files.where("compile_status = 'excluded'")).select("name", "file", "type")


@add("j22_annotate_symbols", """
select s.name, coalesce(f.scope_type,'project') as scope_type, case when f.scope_type='third_party' then 'LVGL' end as scope_name from sym s left join
 (select * from files where compile_status <> 'excluded') f on f.path=s.file""")
def j22(f: Facts):
    known = f.files.where("compile_status <> 'excluded'").withColumn("scope_name", F.when(F.col("scope_type") == "third_party", "LVGL"))
    return callgraph.annotate_symbols(f.symbols, known).select("name", "scope_type", "scope_name")


def verdict_checks(f: Facts):
    """Claimed checks: one per order; the task is the customer."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    cmd = (
        F.when(k % 4 == 0, F.concat(F.lit("make t"), s)).when(k % 4 == 1, F.concat(F.lit("gcc a"), s, F.lit(" && ./run"), s))
        .when(k % 4 == 2, F.concat(F.lit("pytest x"), s, F.lit(" （quick）"))).otherwise(F.concat(F.lit("none"), s))
    )
    return f.table("orders").select(F.lit("firmware").alias("project_id"), F.col("o_custkey").alias("task_id"), k.alias("check_id"), cmd.alias("command"),
                                    (F.col("o_orderstatus") != "P").alias("required"))


def evidence_rows(f: Facts):
    """Recorded commands: one per order line of the same customer."""
    li = f.table("lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_suppkey", "l_extendedprice")
    rows = li.join(f.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    s = k.cast("string")
    cmd = (
        F.when((k % 4 == 0) & (n <= 3), F.concat(F.lit("make  t"), s)).when((k % 4 == 1) & (n == 2), F.concat(F.lit("gcc a"), s))
        .when((k % 4 == 1) & (n == 4), F.concat(F.lit("cd x; gcc a"), s, F.lit(" && ./run"), s)).when((k % 4 == 2) & (n <= 4), F.concat(F.lit("python -m pytest x"), s))
        .otherwise(F.concat(F.lit("ls "), s, F.lit("_"), n.cast("string")))
    )
    return rows.select(
        F.lit("firmware").alias("project_id"), F.col("o_custkey").alias("task_id"),
        (k * 10 + n).alias("ord"), cmd.alias("command"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("exit_code"), "l_extendedprice",
    ).groupBy("project_id", "task_id", "ord", "command").agg(F.min("exit_code").alias("exit_code"))


EVIDENCE = {
    "chk": """select o_custkey as task_id, o_orderkey as check_id, o_orderstatus <> 'P' as required, case o_orderkey % 4 when 0 then concat('make t',cast(o_orderkey as varchar)) when 1 then
      concat('gcc a',cast(o_orderkey as varchar),' && ./run',cast(o_orderkey as varchar)) when 2 then concat('pytest x',cast(o_orderkey as varchar),' （quick）') else concat('none',cast(o_orderkey as varchar)) end as command from orders""",
    "evd": """select task_id, ord, command, min(exit_code) as exit_code, regexp_replace(command,'\\s+','','g') as n from (select o_custkey as task_id, l_orderkey*10+l_linenumber as ord,
      case when l_linestatus='F' then 0 else 1 end as exit_code,
      case when l_orderkey % 4 = 0 and l_linenumber <= 3 then concat('make  t',cast(l_orderkey as varchar)) when l_orderkey % 4 = 1 and l_linenumber=2 then concat('gcc a',cast(l_orderkey as varchar))
       when l_orderkey % 4 = 1 and l_linenumber=4 then concat('cd x; gcc a',cast(l_orderkey as varchar),' && ./run',cast(l_orderkey as varchar))
       when l_orderkey % 4 = 2 and l_linenumber<=4 then concat('python -m pytest x',cast(l_orderkey as varchar)) else concat('ls ',cast(l_orderkey as varchar),'_',cast(l_linenumber as varchar)) end as command
      from lineitem join orders on o_orderkey=l_orderkey) group by task_id, ord, command""",
    "norms": """select *, regexp_replace(regexp_replace(command,'（[^）]*）|\\([^)]*\\)','','g'),'\\s+','','g') as target,
      [x for x in [regexp_replace(y,'\\s+','','g') for y in string_split_regex(regexp_replace(command,'（[^）]*）|\\([^)]*\\)','','g'),'&&|\\|\\||;|\\n')] if x <> ''] as parts from chk""",
    "found": """select check_id, task_id, arg_min([cast(ord as varchar), cast(exit_code as varchar), cast(rk as varchar), e_command], (rk, ord)) as b from (
      select c.check_id, c.task_id, e.ord, e.exit_code, e.command as e_command, case when e.n = c.target then 1 when len(c.parts) > 1 and len([p for p in c.parts if not contains(e.n, p)]) = 0 then 2
       when len(c.parts) > 1 and list_contains(c.parts, e.n) then 3 when contains(e.n, c.target) or contains(c.target, e.n) then 4 end as rk
      from norms c join evd e on e.task_id=c.task_id where c.target <> '' and e.n <> '') where rk is not null group by check_id, task_id""",
}


@add("j18_find_evidence", """
select task_id, check_id, cast(b[1] as bigint) as ord, b[4] as evidence, cast(b[2] as integer) as exit_code from found where not (b[3]='3' and b[2] <> '0')""", EVIDENCE)
def j18(f: Facts):
    return decisions.find_evidence(verdict_checks(f), evidence_rows(f)).select(
        "task_id", "check_id", "ord", F.col("evidence_command").alias("evidence"), "exit_code")
