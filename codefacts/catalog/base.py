"""Registry of checked queries: a Spark callable and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codefacts.projection import Facts

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The projection of codefacts.projection in SQL.
VIEWS = {
    "sym": """select 'firmware' as project_id, p_partkey as ord,
        concat(replace(p_name,' ','_'),'_',cast(p_partkey as varchar)) as name,
        concat(replace(p_brand,'#','_'),'::',replace(p_name,' ','_'),'_',cast(p_partkey as varchar)) as qualified_name,
        case p_partkey % 5 when 0 then 'macro' when 1 then 'struct' when 2 then 'enum' else 'function' end as type,
        concat(case p_partkey % 4 when 0 then 'Drivers/BSP' when 1 then 'App' when 2 then 'Middlewares/LVGL'
               else 'User/hmi' end,'/',replace(p_brand,'#','_'),'/',lower(p_type),'_',cast(p_partkey % 7 as varchar),
               case when p_partkey % 5=0 then '.h' else '.c' end) as file,
        p_size as start_line, p_size + 9 as end_line, replace(p_brand,'#','_') as module from part""",
    "files": """select project_id, file as path, min(ord) as ord,
        case min(ord) % 4 when 2 then 'not_compiled' when 3 then 'excluded' else 'compiled' end as compile_status,
        case when file like 'Middlewares/%' then 'third_party' else 'project' end as scope_type
        from sym group by project_id, file""",
    "calls": """select 'firmware' as project_id, a.name as caller, b.name as callee, a.file as file,
        b.file as callee_file, a.module as module, b.module as callee_module, l.l_linenumber as line,
        case when l.l_returnflag <> 'R' then round(1-6*l.l_discount,2) end as confidence_score,
        case when l.l_returnflag = 'R' then 'medium' when round(1-6*l.l_discount,2)>=0.8 then 'high'
             when round(1-6*l.l_discount,2)>=0.5 then 'medium' else 'low' end as confidence
        from lineitem l join orders o on o.o_orderkey=l.l_orderkey join sym a on a.ord=l.l_partkey
        join sym b on b.ord=o.o_custkey""",
    "includes": """select distinct project_id, file as src, callee_file as target from calls
        where callee_file like '%.h' and file <> callee_file""",
    "nodes": """select project_id, concat('s',cast(ord as varchar)) as id, type as kind, name, qualified_name, file as file_path,
        start_line, end_line from sym union all select project_id, concat('f:',path), 'file', path, path, path, 1, 1 from files""",
    "edges": """select 'firmware' as project_id, concat('s',cast(l_partkey as varchar)) as source,
        concat('s',cast(o_custkey as varchar)) as target, 'calls' as kind,
        case when l_returnflag <> 'R' then concat('{"confidence":',cast(round(1-6*l_discount,2) as varchar),'}') else null end as metadata,
        l_linenumber as line from lineitem join orders on o_orderkey=l_orderkey
        union all select project_id, concat('f:',src), concat('f:',target), 'imports', null, 1 from includes""",
    "field_usage": """select distinct 'firmware' as project_id,
        concat(lower(p.p_type),'_f',cast(p.p_partkey % 50 as varchar)) as field, s.name as function,
        case when l.l_linestatus='F' then 'write' else 'read' end as access
        from lineitem l join part p on p.p_partkey=l.l_partkey join sym s on s.ord=l.l_suppkey""",
    "bindings": """select 'firmware' as project_id, s.name as name,
        case l.l_returnflag when 'A' then 'field_assign' when 'N' then 'table_assign' else 'register_call' end as via,
        pl.file as file, l.l_linenumber as line, pl.name as caller_hint,
        case when l.l_returnflag='A' then concat(lower(p.p_type),'_f',cast(p.p_partkey % 50 as varchar)) else '' end
        as field from lineitem l join sym s on s.ord=l.l_suppkey join sym pl on pl.ord=l.l_partkey
        join part p on p.p_partkey=l.l_partkey""",
    "struct_fields": """select s.project_id, s.ord, s.name as struct, s.file, i.i as i,
        concat(lower(p.p_type),'_f',cast((s.ord + i.i) % 50 as varchar)) as field, s.start_line + i.i + 1 as line
        from sym s join part p on p.p_partkey=s.ord, (values (0),(1),(2)) i(i) where s.type='struct'""",
    "ev": """select 'firmware' as project_id, event_id as seq, user_id as task_id, ts,
        case event_type when 'click' then 'ToolStarted' when 'view' then 'ToolFinished'
        when 'signup' then 'TaskStateChanged' when 'purchase' then 'TestFinished' else 'FindingCreated' end as type,
        value, props as payload from events""",
    "plan_changes": """select 'firmware' as project_id, o.o_custkey as plan_id, o.o_orderkey as ord, s.file as file,
        case when o.o_orderpriority='5-LOW' then 'missing_symbol' else s.name end as symbol,
        case when o.o_orderstatus='P' then 'add' else 'modify' end as operation
        from orders o join (select l_orderkey, min(l_partkey) as pk from lineitem group by l_orderkey) f
        on f.l_orderkey=o.o_orderkey join sym s on s.ord=f.pk""",
    "docpath": """select d.*, l.quality, l.toxic, concat(source,'/',lang,'/d',cast(d.doc_id as varchar),
        case when lang='de' then '.h' else '.c' end) as path from documents d left join labels l on l.doc_id=d.doc_id""",
    "docall": "select source as project_id, path, text from docpath",
    "docold": "select source as project_id, path, text from docpath where quality is not null",
    "docnew": """select source as project_id, path, case when quality=1 then concat(text,' // edit') else text end as text
        from docpath where coalesce(toxic,0)=0""",
    "messages": """select 'firmware' as project_id, conv_id as task_id, turn as ord, role as sender, text as content
        from conversations""",
    "questions": """select 'firmware' as project_id, c_custkey as query_id, concat('fix the ',lower(c_mktsegment),' of _',
        cast(c_custkey as varchar)) as text from customer""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the views it names (directly or through other views) as common table expressions."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in order and re.search(rf"\b{name}\b", text) and text is not views[name]:
                visit(views[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "with " + ", ".join(f"{n} as materialized ({views[n]})" for n in order) + " " + body


def add(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Decorator: registers a function of ``Facts`` under ``name``."""

    def wrap(fn: Callable[[Facts], DataFrame]):
        SPARK[name] = lambda spark, folder: fn(Facts(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, extra)
        return fn

    return wrap
