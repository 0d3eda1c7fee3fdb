"""Batched questions, impact data, candidates and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.aggregates import VIA, deps, mfiles, msyms
from codefacts.catalog.base import add
from codefacts.catalog.joins import ASKED, INDIRECT_VIEW, asked_names, indirect
from codefacts.catalog.scalars import _layer_sql
from codefacts.functions import fixed
from codefacts.functions.words import classify_module
from codefacts.operators import candidates, lookups
from codefacts.plans import questions
from codefacts.projection import Facts

STOP = "^(" + "|".join(fixed.STOP_WORDS) + ")$"
HITS = {
    "qkw": f"""select query_id, part as keyword, min(ti * 1000 + pi) as pos from (select query_id, ti, lower(part) as part, pi from (
       select query_id, ti, unnest(string_split(tok,'_')) as part, generate_subscripts(string_split(tok,'_'),1) as pi from (
        select query_id, unnest(t) as tok, generate_subscripts(t,1) as ti from (select query_id, regexp_extract_all(text,'[A-Za-z_][A-Za-z0-9_]*') as t from questions)) where not regexp_matches(lower(tok),'{STOP}')))
       where length(part)>=2 and not regexp_matches(part,'{STOP}') group by query_id, part""",
    "sh": "select query_id, name, ord as first_ord, file, type, min_by(keyword,pos) as hit from qkw join sym on contains(lower(name),keyword) or contains(lower(qualified_name),keyword) group by all",
    "fh": "select query_id, path, ord, min_by(keyword,pos) as hit from qkw join files on contains(lower(path),keyword) group by all",
    "eh": """select query_id, file, line, caller, callee, confidence, count(*) as n, max(a) as hit_caller, max(b) as hit_callee from (
       select s.query_id, c.file, c.line, c.caller, c.callee, c.confidence, max(case when s.name=c.caller then 1 else 0 end) as a, max(case when s.name=c.callee then 1 else 0 end) as b
        from (select *, row_number() over () as id from calls) c join sh s on s.name=c.caller or s.name=c.callee group by s.query_id, c.id, c.file, c.line, c.caller, c.callee, c.confidence) group by all""",
    "hf": """select query_id, path, min((step, reason)) as b from (select query_id, path, 0 as step, hit as reason from fh
       union all select query_id, file, 1, concat('symbol:',min_by(name,first_ord)) from sh group by query_id, file
       union all select query_id, s.file, 2, 'via:caller' from eh join sym s on s.name=eh.caller where hit_caller=0 union all select query_id, s.file, 2, 'via:callee' from eh join sym s on s.name=eh.callee where hit_callee=0) group by query_id, path""",
    "hfs": "select query_id, path, b[1] as step, b[2] as reason from hf",
    "flow": """select query_id, symbol, 0 as step, min((file,line,caller,callee,side)) as p from (select query_id, file, line, caller, callee, 0 as side, caller as symbol from eh union all select query_id, file, line, caller, callee, 1, callee from eh) group by query_id, symbol
       union all select query_id, name, 1, null from sh where not exists (select 1 from eh where eh.query_id=sh.query_id and (eh.caller=sh.name or eh.callee=sh.name))""",
}


def answers(f: Facts):
    return questions.Answers(f.questions, f.symbols, f.files, f.calls, f.includes)


@add("q1_query_index", """
select query_id, 'file' as kind, path as item, reason, rank from (select *, row_number() over (partition by query_id order by step, path) as rank from hfs) where rank<=15
union all select query_id, 'symbol', name, hit, rank from (select *, row_number() over (partition by query_id order by first_ord, name) as rank from sh) where rank<=25
union all select query_id, 'call', concat(caller,' -> ',callee), confidence, rank from (select *, row_number() over (partition by query_id order by file, line, caller, callee, confidence) as rank from eh) where rank<=40""", HITS)
def q1(f: Facts):
    return questions.query_index(answers(f)).drop("project_id")


@add("q2_find_symbols", "select query_id, name, first_ord, file, type, hit from sh", HITS)
def q2(f: Facts):
    return answers(f).symbols.drop("project_id")


@add("q2_find_files", "select query_id, path, ord, hit from fh", HITS)
def q2f(f: Facts):
    return answers(f).files.drop("project_id")


@add("g6_expand_one_hop", "select query_id, caller, callee, file, line, confidence, n from eh", HITS)
def g6(f: Facts):
    return answers(f).edges.select("query_id", "caller", "callee", "file", "line", "confidence", "n")


EXP = {**HITS, "hb": "select distinct query_id, path, regexp_extract(path,'[^/]+$') as base from fh",
       "exp": """select distinct query_id, path, reason from (select h.query_id, i.target as path, 'included_by' as reason from hb h join includes i on regexp_extract(i.src,'[^/]+$')=h.base
         union select h.query_id, i.src, 'includes' from hb h join includes i on regexp_extract(i.target,'[^/]+$')=h.base) x where not exists (select 1 from hb where hb.query_id=x.query_id and hb.base=regexp_extract(x.path,'[^/]+$'))"""}


@add("g7_expand_includes", "select * from exp", EXP)
def g7(f: Facts):
    return questions.expand_includes(answers(f).files, f.includes).drop("project_id")


@add("q7_related_modules", """
select query_id, module, cast(rank as integer) as rank from (select query_id, module, row_number() over (partition by query_id order by step, module) as rank from (select query_id, module, min(step) as step from (
 select query_id, regexp_replace(regexp_extract(path,'[^/]+$'),'\\.[^.]*$','') as module, 0 as step from exp union all select query_id, lower(string_split(path,'/')[-2]), 1 from fh) group by query_id, module)) where rank<=10""", EXP)
def q7(f: Facts):
    return questions.related_modules(answers(f).files, f.includes).drop("project_id")


@add("q8_build_facts", "select query_id, ['compiled','not_compiled','excluded'][min(case compile_status when 'compiled' then 1 when 'not_compiled' then 2 else 3 end)] as compile_status from fh join files f on f.path=fh.path group by query_id", HITS)
def q8(f: Facts):
    from codefacts.operators.scope import best_status

    return best_status(answers(f).files.drop("ord"), f.files, ["project_id", "query_id"]).drop("project_id")


@add("q4_search_feature", """
select q.query_id, case when k.kw is not null and (coalesce(f.n,0)>0 or coalesce(s.n,0)>0) then coalesce(s.feature,k.kw) end as feature, case when k.kw is null or (coalesce(f.n,0)=0 and coalesce(s.n,0)=0) then 'low' when coalesce(s.n,0)>0 and coalesce(e.n,0)>0 then 'high' else 'medium' end as confidence,
 coalesce(s.n,0) as n_symbols, coalesce(f.n,0) as n_files, coalesce(e.n,0) as n_edges, f.st as compile_status, case when f.st is null or f.st='excluded' or f.ex or (coalesce(s.n,0)=0 and coalesce(e.n,0)=0) then 'read_source' else 'answer' end as recommended_action, case when coalesce(f.n,0)=0 and coalesce(s.n,0)=0 then 'no matching symbols/files' end as reason
from questions q left join (select query_id, min_by(keyword,pos) as kw from qkw group by query_id) k on k.query_id=q.query_id left join (select query_id, count(*) as n, min_by(name,first_ord) as feature from sh group by query_id) s on s.query_id=q.query_id
left join (select query_id, count(*) as n, ['compiled','not_compiled','excluded'][min(case compile_status when 'compiled' then 1 when 'not_compiled' then 2 else 3 end)] as st, bool_or(compile_status='excluded') as ex from hfs join files f on f.path=hfs.path where step<>1 group by query_id) f on f.query_id=q.query_id
left join (select query_id, cast(sum(n) as bigint) as n from eh group by query_id) e on e.query_id=q.query_id""", HITS)
def q4(f: Facts):
    return questions.search_feature(answers(f)).drop("project_id")


@add("q28_no_evidence", """
select ask, case when m.a is null then 'low' else 'found' end as confidence from asked left join (select distinct ask as a from asked join sym on contains(lower(name), lower(ask))) m on m.a=ask""", ASKED)
def q28(f: Facts):
    found = questions.search_symbol(asked_names(f), f.symbols.withColumn("semantic", F.lit(True)), f.calls, f.files, f.symbols.select("project_id", "name", "module"))
    return found.select("ask", F.when(F.col("confidence") == "low", "low").otherwise("found").alias("confidence"))


@add("q5_search_architecture", """
select q.query_id, q.text as topic, coalesce(n,0) as steps, case when n>=2 then 'high' when n=1 then 'medium' else 'low' end as confidence, case when n>=1 then 'answer' else 'read_source' end as recommended_action from questions q
left join (select query_id, count(*) as n from flow group by query_id) c on c.query_id=q.query_id""", HITS)
def q5(f: Facts):
    return questions.search_architecture(answers(f)).drop("project_id")


@add("w12_linearize_chain", "select query_id, symbol, step, p[1] as file, p[2] as line, p[3] as caller, p[4] as callee, p[5] as side from flow", HITS)
def w12(f: Facts):
    return questions.linear_flow(answers(f)).drop("project_id")


SYMQ = {**ASKED, "best": """select ask, name, ord from (select ask, name, ord, row_number() over (partition by ask order by case when ask=name then 0 when lower(ask)=lower(name) then 1 else 2 end, ord) as rn
   from asked join sym on contains(lower(name), lower(ask))) where rn=1""",
        "symq": """select a.ask, s.name, s.file, s.type, s.start_line, s.module, f.compile_status, coalesce(c.n,0) as n_callers, coalesce(d.n,0) as n_callees, coalesce(c.nf,0) as n_caller_files,
   case when s.name is null then 'low' when coalesce(c.n,0)+coalesce(d.n,0)>0 then 'high' else 'medium' end as confidence, case when s.name is null then 'read_source' when s.start_line <= 3 then 'reindex'
   when coalesce(c.n,0)+coalesce(d.n,0)=0 or f.compile_status='excluded' then 'read_source' else 'answer' end as recommended_action
 from asked a left join best b on b.ask=a.ask left join sym s on s.ord=b.ord left join files f on f.path=s.file
 left join (select callee, count(*) as n, count(distinct file) as nf from calls group by callee) c on c.callee=s.name left join (select caller, count(*) as n from calls group by caller) d on d.caller=s.name"""}


def symq(f: Facts):
    return questions.search_symbol(asked_names(f), f.symbols.withColumn("semantic", F.col("start_line") > 3), f.calls, f.files, f.symbols.select("project_id", "name", "module"))


@add("q3_search_symbol", "select * from symq", SYMQ)
def q3(f: Facts):
    return symq(f).drop("project_id")


@add("q30_legacy_action", "select ask, recommended_action, recommended_action as recommended_next_action from symq", SYMQ)
def q30(f: Facts):
    return questions.with_legacy_action(symq(f)).select("ask", "recommended_action", "recommended_next_action")


@add("q10_symbol_card", """
select q.ask, concat('Evidence:\n\n[Definition]\n  File: ',file,'\n  Line: ',start_line,'\n\n[Callers]\n',coalesce(a.l,'  (none)'),'\n\n[Callees]\n',coalesce(b.l,'  (none)'),'\n\nConfidence: ',confidence) as card from symq q
left join (select callee as name, string_agg(concat('  ',caller,'()'), '\n' order by file, line, caller) as l from (select *, row_number() over (partition by callee order by file, line, caller) as rn from calls) where rn<=20 group by callee) a on a.name=q.name
left join (select caller as name, string_agg(concat('  ',callee,'()'), '\n' order by file, line, callee) as l from (select *, row_number() over (partition by caller order by file, line, callee) as rn from calls) where rn<=20 group by caller) b on b.name=q.name
where q.name is not null""", SYMQ)
def q10(f: Facts):
    return questions.symbol_card(symq(f), f.calls).select("ask", "card")


@add("q6_search_module", """
select upper(module) as ask, module, case when n >= 85 then 'high' else 'medium' end as confidence, 'answer' as recommended_action, n from (select module, count(*) as n from sym group by module)""")
def q6(f: Facts):
    m = f.symbols.groupBy("project_id", "module").agg(F.min("ord").alias("ord"), F.count("*").alias("n")).withColumn("confidence", F.col("n") / 100)
    return questions.search_module(m.select("project_id", F.upper("module").alias("ask")), m).drop("project_id")


IMP = {**HITS, **INDIRECT_VIEW, "simp": """select x.query_id, s.name, case when x.d=1 then 'direct' else 'indirect' end as impact, s.file, s.type, s.module, f.compile_status, coalesce(a.n,0) as callers, coalesce(b.n,0) as callees, coalesce(r.n,0) as registered_by, coalesce(i.n,0) as include_by
  from (select query_id, name, max(d) as d from (select query_id, caller as name, 0 as d from eh union all select query_id, callee, 0 from eh union all select query_id, name, 1 from sh) group by query_id, name) x join sym s on s.name=x.name join files f on f.path=s.file
  left join (select callee, count(distinct caller) as n from calls group by callee) a on a.callee=s.name left join (select caller, count(distinct callee) as n from calls group by caller) b on b.caller=s.name
  left join (select callee, count(*) as n from indirect group by callee) r on r.callee=s.name left join (select regexp_extract(target,'[^/]+$') as base, count(distinct src) as n from includes group by 1) i on i.base=regexp_extract(s.file,'[^/]+$')"""}


def simp(f: Facts):
    a = answers(f)
    return a, questions.symbol_impact(a, f.symbols.select("project_id", "name", "module"), indirect(f))


@add("q9_symbol_impact", "select * from simp", IMP)
def q9(f: Facts):
    return simp(f)[1].drop("project_id")


@add("q9_module_impact", """
select query_id, module, case when min(r)=0 then 'direct' else 'indirect' end as impact from (select query_id, module, case when impact='direct' then 0 else 1 end as r from simp
 union all select query_id, m.module, 0 from fh join (select file, min(module) as module from sym group by file) m on m.file=fh.path) group by query_id, module""", IMP)
def q9m(f: Facts):
    a, s = simp(f)
    home = lookups.module_of_file(f.files, mfiles(f))
    return questions.module_impact(s, a.files.join(home, ["project_id", "path"])).drop("project_id")


CAND = {**HITS, **VIA, **INDIRECT_VIEW,
        "msrc": """select module, count(distinct source) as n from (select s.module, 'call_graph' as source from sym s where name in (select caller from calls) or name in (select callee from calls)
          union select module, 'indirect_calls' from sym where name in (select callee from indirect) or file in (select file from indirect) union select module, 'struct_usage' from sym where name in (select function from field_usage)
          union select "from", 'dependencies' from deps union select "to", 'consumers' from deps) group by module""",
        "mimp": """select distinct m, o from (select module as m, callee_module as o from calls where module<>callee_module union select callee_module, module from calls where module<>callee_module)""",
        "cand": """select *, row_number() over (partition by query_id order by score desc, module) as rank from (select h.query_id, h.module, case when coalesce(s.n,0)>=2 then 'HIGH' when s.n=1 then 'MEDIUM' else 'LOW' end as confidence, round(0.3+0.35*least(coalesce(s.n,0),3),2) as score,
          coalesce(s.n,0) as n_sources, coalesce(i.n,0) as n_impacted, case when coalesce(i.n,0)>5 or lib then 'high' when i.n>0 then 'medium' else 'low' end as risk_level from
          (select distinct query_id, module from (select query_id, m.module from fh join (select file, min(module) as module from sym group by file) m on m.file=fh.path union select query_id, s.module from sh join sym s on s.name=sh.name)) h
          left join msrc s on s.module=h.module left join (select m, count(*) as n from mimp group by m) i on i.m=h.module left join (select module, bool_and(file like 'Middlewares/%') as lib from sym group by module) l on l.module=h.module)"""}


def cand(f: Facts):
    f.shared_calls()
    a = answers(f)
    home = lookups.module_of_file(f.files, mfiles(f))
    own = f.symbols.select("project_id", "name", "module")
    hit = a.files.join(home, ["project_id", "path"]).select("project_id", "query_id", "module").unionByName(
        a.symbols.join(own, ["project_id", "name"]).select("project_id", "query_id", "module"))
    imp = candidates.impacted_modules(msyms(f), f.calls)
    src = candidates.module_sources(msyms(f), mfiles(f), f.calls, indirect(f), f.field_usage, deps(f))
    lib = f.symbols.groupBy("project_id", "module").agg(F.bool_and(F.startswith("file", F.lit("Middlewares/"))).alias("third_party"), F.min("file").alias("ff"))
    return candidates.analyze_candidates(hit, src, imp, lib), imp, lib


@add("q14_analyze_candidates", "select query_id, module, confidence, score, n_sources, n_impacted, risk_level, format('C{:03d}', rank) as id from cand", CAND)
def q14(f: Facts):
    return cand(f)[0].drop("project_id", "rank")


@add("w6_score_gap", "select query_id, round(max(score) filter (where rank=1) - max(score) filter (where rank=2),2) as gap from cand group by query_id", CAND)
def w6(f: Facts):
    return candidates.score_gap(cand(f)[0]).drop("project_id")


GATED = {
    **CAND,
    "modkinds": f"select module, {_layer_sql().replace('lower(file)', 'lower(ff)')} as type from (select module, min(file) as ff from sym group by module)",
    "modlayers": "select m as module, list(distinct k.type) as types from mimp join modkinds k on k.module=o group by m",
    "pub": "select distinct module from sym where type in ('struct','enum') and start_line > 49",
    "gateagg": """select c.query_id, count(*) as n, bool_or(p.module is not null or coalesce(d.n,0) >= 3) as public, round(max(score) filter (where rank=1) - max(score) filter (where rank=2),2) as gap,
      max(c.module) filter (where rank=1) as module, max(confidence) filter (where rank=1) as confidence, max(n_impacted) filter (where rank=1) as n_impacted
      from cand c left join pub p on p.module=c.module left join (select "to", count(*) as n from deps group by "to") d on d."to"=c.module group by c.query_id""",
    "gate": """select query_id, n, confidence, g.module, concat_ws(',', case when n >= 2 then 'several_candidates' end, case when n >= 2 and gap < 0.2 then 'close_scores' end, case when public then 'public_interface' end,
      case when n_impacted > 5 then 'large_impact' end, case when coalesce(k.type,'unknown') <> 'unknown' and len(coalesce(l.types,[])) > 0 and len(list_distinct(list_append(coalesce(l.types,[]), k.type))) >= 2 then 'crosses_layers' end) as reasons
      from gateagg g left join modkinds k on k.module=g.module left join modlayers l on l.module=g.module""",
}


@add("q15_evaluate_gate", """
select query_id, not (reasons = '' and n = 1 and confidence = 'HIGH') as confirm, reasons, case when reasons = '' and n = 1 and confidence = 'HIGH' then module end as selected from gate""", GATED)
def q15(f: Facts):
    """Public are modules that hold a struct or an enum which starts late in its file."""
    c, imp, lib = cand(f)
    cons = deps(f).groupBy("project_id", F.col("to").alias("module")).agg(F.count("*").alias("n"))
    public = f.symbols.where("type in ('struct','enum') and start_line > 49").select("project_id", "module")
    types = lib.select("project_id", "module", classify_module("module", "ff").alias("type"))
    return candidates.evaluate_gate(c, cons, public, imp, types).drop("project_id")
