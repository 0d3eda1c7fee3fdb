"""Projections, predicates and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.base import add
from codefacts.catalog.rules import rules
from codefacts.functions import fixed, paths, records, words
from codefacts.operators import callgraph, grounding, scope, status
from codefacts.projection import Facts

PATH_SQL = "select distinct file as path from sym"


def _paths(f: Facts):
    return f.symbols.select("project_id", F.col("file").alias("path")).distinct()


def _in(words_: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words_)


def _alt(words_: list[str]) -> str:
    return "(" + "|".join(w.replace(".", "\\.").replace("-", "\\-") for w in words_) + ")"


@add("p1_symbols_from_nodes", """
select project_id, name, qualified_name, kind as type, file_path as file, start_line from nodes
where kind not in ('file','import') and not (file_path like 'App/Brand_1/%' or file_path like '%\\_6.h' escape '\\')
""")
def p1(f: Facts):
    return callgraph.symbols_from_nodes(f.nodes, rules(f)).select("project_id", "name", "qualified_name", "type", "file", "start_line")


@add("p2_confidence_level", """
select l_orderkey, l_linenumber, l_discount, case when l_returnflag='R' then 'medium'
  when round(1-6*l_discount,2)>=0.8 then 'high' when round(1-6*l_discount,2)>=0.5 then 'medium' else 'low' end as level
from lineitem""")
def p2(f: Facts):
    score = F.when(F.col("l_returnflag") != "R", F.round(1 - 6 * F.col("l_discount"), 2))
    return f.table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", records.confidence_level(score).alias("level"))


@add("p3_edge_metadata", """
select project_id, source, target, line, try_cast(json_extract_string(metadata,'$.confidence') as double) as score
from edges where kind='calls'""")
def p3(f: Facts):
    return f.edges.where("kind = 'calls'").select("project_id", "source", "target", "line", records.edge_confidence("metadata").alias("score"))


SCOPE_SQL = """case when {p} like 'App/Brand_1/%' or {p} like '%\\_6.h' escape '\\' then 'ignored'
  when {p} like 'Middlewares/LVGL/%' then 'third_party' else 'project' end"""


@add("p4_scope_of_file", f"""
select project_id, path, {SCOPE_SQL.format(p='path')} as scope_type,
  case when {SCOPE_SQL.format(p='path')} = 'third_party' then 'lvgl-lib' end as scope_name
from (select distinct project_id, file as path from sym)""")
def p4(f: Facts):
    return scope.classify_scope(_paths(f), rules(f), keep_ignored=True)


PATTERNS = ["App/Brand_1/**", "*_6.h", "Drivers", "small_?.c", "User/hmi/Brand_*", "Drivers/BSP/Brand_2", "*.c/**"]


@add("p5_ignore_match", """
select path, pattern, case pattern
  when 'App/Brand_1/**' then path like 'App/Brand\\_1/%' escape '\\'
  when '*_6.h' then path like '%\\_6.h' escape '\\'
  when 'Drivers' then path like 'Drivers/%'
  when 'small_?.c' then regexp_full_match(path, 'small_..c')
  when 'User/hmi/Brand_*' then path like 'User/hmi/Brand\\_%' escape '\\'
  when 'Drivers/BSP/Brand_2' then path like 'Drivers/BSP/Brand\\_2/%' escape '\\'
  else path like '%.c' end as hit
from (select distinct file as path from sym), (select unnest(['App/Brand_1/**','*_6.h','Drivers','small_?.c','User/hmi/Brand_*',
  'Drivers/BSP/Brand_2','*.c/**']) as pattern)""")
def p5(f: Facts):
    pats = F.explode(F.array(*[F.lit(p) for p in PATTERNS])).alias("pattern")
    return _paths(f).select("path", pats).select("path", "pattern", paths.ignore_match("path", "pattern").alias("hit"))


@add("p6_normalize_scope_path", """
select p_partkey, concat('lib/', lower(p_type), '/', replace(p_brand,'#','_')) as norm, replace(p_brand,'#','_') as name from part""")
def p6(f: Facts):
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    raw = F.concat(F.lit("'/lib\\"), F.lower("p_type"), F.lit("\\"), brand, F.lit("/**'"))
    norm = paths.normalize_scope_path(raw)
    return f.table("part").select("p_partkey", norm.alias("norm"), paths.scope_name_of(norm).alias("name"))


@add("p7_path_helpers", """
select ord, lower(file) as norm, regexp_extract(file,'[^/]+$') as base, replace(replace(regexp_extract(file,'[^/]+$'),'.c',''),'.h','') as stem,
  module as leaf, split_part(file,'/',1) as top, true as same from sym""")
def p7(f: Facts):
    raw = F.concat(F.lit("./"), F.replace("file", F.lit("/"), F.lit("\\")))
    return f.symbols.select(
        "ord", paths.norm_path(raw).alias("norm"), paths.base_name(raw).alias("base"), paths.stem_of("file").alias("stem"),
        paths.leaf_dir("file").alias("leaf"), paths.top_dir("file").alias("top"),
        paths.same_file(F.concat(F.lit("repo/"), "file"), "file").alias("same"),
    )


STOP = "^" + "(" + "|".join(fixed.STOP_WORDS) + ")$"
KEYWORD_VIEWS = {
    "kw": f"""select doc_id, part as keyword, min(tok_i * 1000 + part_i) as pos from (
        select doc_id, tok_i, lower(part) as part, part_i from (
          select doc_id, tok_i, unnest(parts) as part, generate_subscripts(parts,1) as part_i from (
            select doc_id, tok_i, string_split(regexp_replace(tok,'([a-z0-9])([A-Z])','\\1 \\2','g'),'_') as parts from (
              select doc_id, unnest(toks) as tok, generate_subscripts(toks,1) as tok_i from (
                select doc_id, regexp_extract_all(text,'[A-Za-z_][A-Za-z0-9_]*') as toks from documents))
            where not regexp_matches(lower(tok),'{STOP}'))))
        where length(part) >= 2 and not regexp_matches(part,'{STOP}') group by doc_id, part""",
}


@add("p8_extract_keywords", """
select doc_id, keyword, cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as pos from kw""", KEYWORD_VIEWS)
def p8(f: Facts):
    return f.table("documents").select("doc_id", F.posexplode(words.extract_keywords("text")).alias("pos", "keyword"))


@add("p9_symbol_tokens", """
select ord, cast(i - 1 as integer) as pos, lower(t) as token from (
  select ord, unnest(p) as t, generate_subscripts(p,1) as i from (select ord, string_split(name,'_') as p from sym)) where t <> ''""")
def p9(f: Facts):
    return f.symbols.select("ord", F.posexplode(words.symbol_tokens("name")).alias("pos", "token"))


@add("p10_path_hit", """
select ord, case when lower(file) like '%brand\\_2%' escape '\\' then 'brand_2' when lower(file) like '%hmi%' then 'hmi'
  when lower(file) like '%promo%' then 'promo' end as hit from sym""")
def p10(f: Facts):
    keys = F.array(F.lit("brand_2"), F.lit("hmi"), F.lit("promo"))
    return f.symbols.select("ord", words.path_hit("file", keys).alias("hit"))


@add("p11_symbol_hit", """
select ord, case when lower(name) like '%gear%' or lower(qualified_name) like '%gear%' then 'gear'
  when lower(qualified_name) like '%brand\\_1::%' escape '\\' then 'brand_1::' when lower(name) like '%red%' then 'red' end as hit from sym""")
def p11(f: Facts):
    keys = F.array(F.lit("gear"), F.lit("brand_1::"), F.lit("red"))
    return f.symbols.select("ord", words.symbol_hit("name", "qualified_name", keys).alias("hit"))


@add("p12_valid_module_token", """
select distinct tok, length(tok) >= 2 and not regexp_matches(tok,'^[0-9]') and regexp_full_match(tok,'[\\p{L}\\p{N}_]+') as ok
from (select lower(unnest(string_split(text,' '))) as tok from documents)""")
def p12(f: Facts):
    parts = f.table("documents").select(F.explode(F.split("text", " ")).alias("w"))
    return parts.select(F.lower("w").alias("tok")).distinct().withColumn("ok", words.valid_module_token("tok"))


def _layer_sql() -> str:
    out = "case"
    for layer, ws in fixed.LAYER_KEYWORDS:
        a = _alt(ws)
        out += f" when regexp_matches(lower(file),'{a}') or regexp_matches(lower(module),'{a}') then '{layer}'"
    return out + " else 'unknown' end"


@add("p13_classify_module", f"select distinct module, file, {_layer_sql()} as layer from sym")
def p13(f: Facts):
    return f.symbols.select("module", "file").distinct().withColumn("layer", words.classify_module("module", "file"))


@add("p14_is_third_party", f"""
select ord, regexp_matches(lower(name),'^{_alt(fixed.LIBRARY_PREFIXES)}') or len(list_filter(string_split(lower(file),'/')[:-2],
  lambda x: list_contains([{_in(fixed.LIBRARY_DIRS)}], x))) > 0 as lib from sym""")
def p14(f: Facts):
    return f.symbols.select("ord", words.is_third_party("name", "file").alias("lib"))


@add("p15_high_risk_header", """
select ord, file like '%.h' as header, file like '%.h' and regexp_matches(lower(regexp_extract(file,'[^/]+$')),
  '(config|types|typedef|common|defs|hal|port)') as risky, regexp_extract(file,'[^/]+$') like '%.h' as shallow from sym""")
def p15(f: Facts):
    return f.symbols.select(
        "ord", paths.is_header("file").alias("header"), paths.is_high_risk_header("file").alias("risky"),
        paths.is_high_risk_header(F.substring_index("file", "/", -2)).alias("shallow"),
    )


@add("p16_is_build_config", """
select ord, base, base in ('Makefile','app.uvprojx','board.IOC') as config from (
 select ord, case ord % 5 when 0 then 'Makefile' when 1 then 'app.uvprojx' when 2 then 'board.IOC' when 3 then 'main.c'
  else 'Makefile.am' end as base from sym)""")
def p16(f: Facts):
    names = F.array(*[F.lit(x) for x in ("Makefile", "app.uvprojx", "board.IOC", "main.c", "Makefile.am")])
    base = F.element_at(names, (F.col("ord") % 5 + 1).cast("int"))
    return f.symbols.select("ord", base.alias("base"), paths.is_build_config(F.concat("file", F.lit("/"), base)).alias("config"))


@add("p17_count_invalid_tokens", """
select source, cast(count(*) filter (where tok <> '' and not regexp_full_match(tok,'[\\p{L}\\p{N}]+')) as bigint) as invalid
from (select source, lower(split_part(unnest(string_split(text,' ')),'_',1)) as tok from documents) group by source""")
def p17(f: Facts):
    w = f.table("documents").select("source", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy("source").agg(F.count_if(words.has_invalid_token("w")).alias("invalid"))


@add("p18_macro_kind", """
select p_partkey, concat('M_',cast(p_partkey as varchar)) as name,
 case p_partkey % 5 when 0 then 'constant' when 1 then 'constant' when 2 then 'function' when 3 then 'flag' else 'constant' end as kind,
 case p_partkey % 5 when 0 then cast(p_size as varchar) when 4 then concat('"', p_name, '"') end as value,
 case p_partkey % 5 when 1 then concat('(', cast(p_size as varchar), ' << 2)') when 2 then '((x) + 1)' end as value_expr from part""")
def p18(f: Facts):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.lit("M_"), k.cast("string"))
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("#define "), name, F.lit(" "), size, F.lit("  // units")))
        .when(k % 5 == 1, F.concat(F.lit("  # define "), name, F.lit(" ("), size, F.lit(" << 2)")))
        .when(k % 5 == 2, F.concat(F.lit("#define "), name, F.lit("(x) ((x) + 1)")))
        .when(k % 5 == 3, F.concat(F.lit("#define "), name))
        .otherwise(F.concat(F.lit("#define "), name, F.lit(' "'), "p_name", F.lit('"')))
    )
    body = words.macro_body(line)
    plain = words.is_plain_value(body)
    kind = words.macro_kind(line)
    return f.table("part").select(
        "p_partkey", words.macro_name(line).alias("name"), kind.alias("kind"),
        F.when((kind == "constant") & plain, body).alias("value"),
        F.when((kind == "function") | ((kind == "constant") & ~plain), body).alias("value_expr"),
    )


def _reply(k):
    """Message text with a payload inside prose; the shape depends on the row."""
    return (
        F.when(k % 4 == 0, F.concat(F.lit('Done: {"findings": [{"description": "d'), k.cast("string"), F.lit('"}]} end')))
        .when(k % 4 == 1, F.concat(F.lit('Result {"conclusion": "PASS", "n": '), k.cast("string"), F.lit("}")))
        .when(k % 4 == 2, F.concat(F.lit('Broken {"conclusion": '), k.cast("string"), F.lit(" x}")))
        .otherwise(F.concat(F.lit("plain }{ "), k.cast("string")))
    )


@add("p19_structured_payload", """
select o_orderkey, case o_orderkey % 4 when 0 then 'finding' when 1 then 'verdict' end as kind from orders""")
def p19(f: Facts):
    return f.table("orders").select("o_orderkey", records.structured_payload(_reply(F.col("o_orderkey"))).alias("kind"))


@add("p20_normalize_plan", """
select o_orderkey, concat(o_orderpriority,'; ',o_orderstatus) as risk, 'modify' as operation,
 concat('f',cast(o_custkey as varchar),'.c') as file, concat('make T=',cast(o_orderkey as varchar)) as command from orders""")
def p20(f: Facts):
    old = f.table("orders").select(
        F.col("o_orderkey").alias("plan_id"),
        F.array(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".c"))).alias("files_involved"),
        F.array("o_orderpriority", "o_orderstatus").alias("risks"),
        F.concat(F.lit("make T="), F.col("o_orderkey").cast("string")).alias("verification"),
        F.array(F.struct(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".c")).alias("file"), F.lit("edit").alias("change"))).alias("steps"),
    )
    new = status.normalize_plan(old)
    return new.select(
        F.col("plan_id").alias("o_orderkey"), "risk", F.col("changes")[0]["operation"].alias("operation"),
        F.col("changes")[0]["file"].alias("file"), F.col("commands")[0].alias("command"),
    )


CMD_SQL = """case o_orderkey % 6 when 0 then concat('sudo make T', cast(o_orderkey as varchar)) when 1 then concat('rm -rf /tmp/x', cast(o_orderkey as varchar))
 when 2 then concat('make -j', cast(o_orderkey as varchar), '（快） all') when 3 then 'git push --force origin' when 4 then concat('gcc a', cast(o_orderkey as varchar), '.c && ./a (run it)') else 'python -m pytest' end"""


def commands(f: Facts):
    k = F.col("o_orderkey")
    s = k.cast("string")
    cmd = (
        F.when(k % 6 == 0, F.concat(F.lit("sudo make T"), s)).when(k % 6 == 1, F.concat(F.lit("rm -rf /tmp/x"), s))
        .when(k % 6 == 2, F.concat(F.lit("make -j"), s, F.lit("（快） all"))).when(k % 6 == 3, "git push --force origin")
        .when(k % 6 == 4, F.concat(F.lit("gcc a"), s, F.lit(".c && ./a (run it)"))).otherwise("python -m pytest")
    )
    return f.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", cmd.alias("command"))


@add("p21_high_risk_command", "select o_orderkey, o_orderkey % 6 in (0,1,3) as risky from orders")
def p21(f: Facts):
    return commands(f).select("o_orderkey", records.is_high_risk_command("command").alias("risky"))


@add("p22_extract_command", """
select o_orderkey, case o_orderkey % 3 when 0 then concat('gcc -c f',cast(o_orderkey as varchar),'.c') when 1 then concat('see note ',cast(o_orderkey as varchar))
 else 'make all' end as command from orders""")
def p22(f: Facts):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("验证：gcc -c f"), k.cast("string"), F.lit(".c；然后看结果")))
        .when(k % 3 == 1, F.concat(F.lit("  see note "), k.cast("string"))).otherwise("first build\nmake all\nthen run")
    )
    return f.table("orders").select("o_orderkey", records.extract_command(text).alias("command"))


@add("p23_command_norm", f"""
select o_orderkey, regexp_replace(regexp_replace({CMD_SQL},'（[^）]*）|\\([^)]*\\)','','g'),'\\s+','','g') as norm from orders""")
def p23(f: Facts):
    return commands(f).select("o_orderkey", records.command_norm("command").alias("norm"))


@add("p24_classify_error", """
select o_orderkey, case when st in (401,403) then 'authentication' when st=429 then 'rate_limit' when st=413 then 'context_length'
 when st in (400,422) then case o_orderkey % 4 when 0 then 'invalid_parameter' when 1 then 'invalid_model' when 2 then 'context_length'
 else 'invalid_parameter' end when st>=500 then 'provider_error' else 'unknown' end as category
from (select o_orderkey, [400,401,403,413,422,429,500,503,200][o_custkey % 9 + 1] as st from orders)""")
def p24(f: Facts):
    codes = F.array(*[F.lit(x) for x in (400, 401, 403, 413, 422, 429, 500, 503, 200)])
    st = F.element_at(codes, (F.col("o_custkey") % 9 + 1).cast("int"))
    bodies = F.array(*[F.lit(x) for x in ("bad Temperature", "Model not found", "maximum context is 8k", "other")])
    return f.table("orders").select(
        "o_orderkey", records.classify_error(st, F.element_at(bodies, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("category")
    )


@add("p24_classify_transport_error", """
select o_orderkey, ['request_timeout','provider_cancel','provider_error'][o_orderkey % 3 + 1] as category from orders""")
def p24t(f: Facts):
    kinds = F.array(F.lit("timeout"), F.lit("read"), F.lit("connect"))
    return f.table("orders").select("o_orderkey", records.classify_transport_error(F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("category"))


@add("p25_sanitize_value", "select doc_id, concat(text, chr(65533)) as text from documents")
def p25(f: Facts):
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return f.table("documents").select("doc_id", records.sanitize_text(raw).alias("text"))


@add("p26_role_for", """
select conv_id, turn, case role when 'user' then 'executor' when 'assistant' then 'reviewer' else 'system' end as role from conversations""")
def p26(f: Facts):
    r = F.col("role")
    sender = F.when(r == "user", F.concat(F.lit("executor-"), F.col("turn").cast("string"))).when(r == "assistant", "reviewer-1").otherwise(r)
    return f.table("conversations").select("conv_id", "turn", records.role_for(sender).alias("role"))


@add("p27_cpu_and_chip", """
select p_partkey, case p_partkey % 3 when 0 then 'Cortex-M4' when 1 then concat('IRAM-',cast(p_size as varchar)) end as cpu,
 case when p_partkey % 2 = 0 then concat('STM32F',cast(p_size as varchar)) end as chip from part""")
def p27(f: Facts):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    cpu = F.when(k % 3 == 0, F.lit('IRAM(0) CPUTYPE("Cortex-M4") CLOCK')).when(k % 3 == 1, F.concat(F.lit(" IRAM-"), s, F.lit(" x")))
    defines = F.when(k % 2 == 0, F.array(F.lit("DEBUG"), F.concat(F.lit("STM32F"), s), F.lit("GD32X"))).otherwise(F.array(F.lit("DEBUG")))
    return f.table("part").select("p_partkey", records.cpu_of(cpu).alias("cpu"), records.chip_of(defines).alias("chip"))


GROUND = {
    "gtok": """select distinct doc_id, source, tok from (select doc_id, source, unnest(regexp_extract_all(text,'[A-Za-z_][A-Za-z0-9_]{2,}')) as tok
        from documents) where tok <> lower(tok)""",
    "gallow": "select distinct d.source, concat(b.w) as name from (select distinct source from documents) d, "
              "(select distinct unnest(regexp_extract_all(text,'[A-Za-z_][A-Za-z0-9_]{2,}')) as w from benchmark) b",
}


def _allowed(f: Facts):
    """Names that texts may use: all words of the benchmark passages."""
    return f.table("benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))).alias("name")
    ).distinct().select(F.lit("all").alias("scope"), "name")


@add("p28_grounded", """
select d.doc_id, coalesce(b.bad,0)=0 as ok from documents d left join (
 select doc_id, count(*) as bad from gtok t where not exists (select 1 from words w where starts_with(w.name, t.tok)) group by doc_id) b
on b.doc_id=d.doc_id""", {
    "gtok": GROUND["gtok"],
    "words": "select distinct unnest(regexp_extract_all(text,'[A-Za-z_][A-Za-z0-9_]{2,}')) as name from benchmark",
})
def p28(f: Facts):
    texts = f.table("documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("id"), "text")
    return grounding.grounded_texts(texts, _allowed(f)).select(F.col("id").alias("doc_id"), "ok")


@add("p29_grounded_prose", """
select d.doc_id, d.text <> '' and coalesce(b.bad,0)=0 as ok from documents d left join (
 select doc_id, count(*) as bad from gtok t where not exists (select 1 from words w where starts_with(w.name, upper(t.tok)) or starts_with(upper(t.tok), w.name))
 group by doc_id) b on b.doc_id=d.doc_id""", {
    "gtok": GROUND["gtok"],
    "words": "select distinct upper(unnest(regexp_extract_all(text,'[A-Za-z_][A-Za-z0-9_]{2,}'))) as name from benchmark",
})
def p29(f: Facts):
    texts = f.table("documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("id"), "text")
    return grounding.grounded_prose_texts(texts, _allowed(f)).select(F.col("id").alias("doc_id"), "ok")


@add("p30_operation_class", """
select seq, case type when 'ToolStarted' then 'READ' when 'ToolFinished' then 'INDEX_WRITE' when 'TaskStateChanged' then 'CODE_WRITE_PREVIEW'
 else 'CODE_WRITE' end as class from ev""")
def p30(f: Facts):
    t = F.col("type")
    action = F.when(t == "ToolStarted", "query").when(t == "ToolFinished", "sync").when(t == "TaskStateChanged", "plan").when(t == "TestFinished", "auto").otherwise("wipe")
    return f.events.select("seq", records.operation_class(action).alias("class"))


@add("p31_decide_index_action", """
select seq, case when value > 100 then 'rebuild' when type='ToolStarted' then 'reuse' when type='ToolFinished' then 'sync' else 'rebuild' end as action,
 case when value > 100 then 'user requested rebuild' when type in ('ToolStarted','ToolFinished') then null when type='TaskStateChanged'
 then 'index missing / corrupted' else 'unknown index state: other' end as reason from ev""")
def p31(f: Facts):
    t = F.col("type")
    state = F.when(t == "ToolStarted", "valid").when(t == "ToolFinished", "STALE").when(t == "TaskStateChanged", "MISSING").otherwise("other")
    force = F.col("value") > 100
    return f.events.select("seq", records.decide_index_action(state, force).alias("action"), records.decide_index_reason(state, force).alias("reason"))


@add("p32_compile_status", """
select f.path, case when c.path is not null then 'compiled' when x.path is not null then 'excluded' else 'not_compiled' end as compile_status
from files f left join (select distinct regexp_extract(path,'[^/]+$') as path from files where compile_status='compiled') c
 on c.path = regexp_extract(f.path,'[^/]+$')
left join (select distinct regexp_extract(path,'[^/]+$') as path from files where compile_status='excluded') x on x.path = regexp_extract(f.path,'[^/]+$')
""")
def p32(f: Facts):
    listed = f.files.where("compile_status in ('compiled', 'excluded')")
    build = listed.select("project_id", "path", (F.col("compile_status") == "compiled").alias("compiled"))
    builds = f.files.groupBy("project_id").agg(F.lit(True).alias("has_build_config"))
    return scope.compile_status(f.files.select("project_id", "path"), build, builds).select("path", "compile_status")


@add("p33_is_skeleton", """
select source as project_id, count(*) filter (where lang='xx') = 0 as skeleton from documents group by source""")
def p33(f: Facts):
    docs = f.table("documents").select(F.col("source").alias("project_id"), "lang")
    counts = docs.groupBy("project_id").agg(F.count_if(F.col("lang") == "xx").alias("symbols"))
    return status.is_skeleton(counts.select("project_id", "symbols", F.lit(0).alias("calls"), F.lit(0).alias("modules"),
                                            F.lit(None).cast("string").alias("codegraph_source"), F.lit(0).alias("capabilities")))


@add("p34_compact_event", "select seq, concat('to=', cast(seq % 7 as varchar), ' tool=', type, ' ok=true') as text from ev")
def p34(f: Facts):
    payload = F.to_json(F.struct((F.lit(True)).alias("ok"), F.col("type").alias("tool"), (F.col("seq") % 7).alias("to"), "value"))
    return f.events.select("seq", records.compact_event(payload).alias("text"))


@add("p35_changes_from_tool_results", """
select seq, task_id, concat('f', cast(seq % 11 as varchar), '.c') as file, case when value > 50 then 'APPEND' else 'WRITE' end as operation
from ev where type='ToolFinished' and value > 10""")
def p35(f: Facts):
    res = f.events.where("type = 'ToolFinished'").select(
        "seq", "task_id", (F.col("value") > 10).alias("ok"),
        F.concat(F.lit("f"), (F.col("seq") % 11).cast("string"), F.lit(".c")).alias("path"), (F.col("value") > 50).alias("append"),
    )
    return status.changes_from_tool_results(res).select("seq", "task_id", "file", "operation")


@add("p36_evidence_from_tool_results", """
select seq, task_id, concat('make ', cast(seq % 5 as varchar)) as command, cast(case when value > 50 then 1 else 0 end as integer) as exit_code
from ev where type='TestFinished' and value > 10""")
def p36(f: Facts):
    res = f.events.where("type = 'TestFinished'").select(
        "seq", "task_id", F.concat(F.lit("make "), (F.col("seq") % 5).cast("string")).alias("command"),
        F.when(F.col("value") > 10, F.when(F.col("value") > 50, 1).otherwise(0)).alias("exit_code"),
    )
    return status.evidence_from_tool_results(res).select("seq", "task_id", "command", "exit_code")
