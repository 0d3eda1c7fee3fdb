"""Sources and lexical extraction over texts that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.base import add
from codefacts.operators import extract
from codefacts.projection import PROJECT, Facts
from codefacts.sources import readers


def spread(f: Facts):
    """The parts dealt to all cores: each of the few rows of this small table becomes a text to work on."""
    return f.table("part").repartition(f.spark.sparkContext.defaultParallelism, "p_partkey")


def c_sources(f: Facts):
    """One C file per part: a macro, a struct with a callback, an enum and a function that uses them."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    t = F.lower("p_type")
    lines = [
        F.concat(F.lit('#include "'), t, F.lit('.h"')), F.concat(F.lit("#define MAX_"), k, F.lit(" "), s),
        F.lit("typedef struct {"), F.concat(F.lit("  int "), t, F.lit(";")), F.concat(F.lit("  char name["), s, F.lit("];")), F.lit("  void (*cb)(int);"), F.concat(F.lit("} S"), k, F.lit(";")),
        F.concat(F.lit("enum E"), k, F.lit(" { A"), k, F.lit(", B"), k, F.lit(" = "), s, F.lit(", C"), k, F.lit(", D"), k, F.lit(" = X + 1, F"), k, F.lit(" };")),
        F.concat(F.lit("static int run_"), k, F.lit("(S"), k, F.lit(" *p, int n) {")), F.concat(F.lit("  p->"), t, F.lit(" = n;")), F.concat(F.lit("  n = p->"), t, F.lit(";")),
        F.concat(F.lit("  p->cb = on_"), k, F.lit(";")), F.concat(F.lit("  register_cb(&on_"), k, F.lit(");")), F.lit("  return n;"), F.lit("}"),
    ]
    path = F.concat(F.lit("src/p"), k, F.when(F.col("p_size") % 2 == 0, F.lit(".c")).otherwise(F.lit(".h")))
    return spread(f).select(F.lit(PROJECT).alias("project_id"), path.alias("path"), F.concat_ws("\n", *lines).alias("text"))


CP = {"cp": "select *, concat('src/p',p_partkey,case when p_size % 2=0 then '.c' else '.h' end) as path, cast(p_partkey as varchar) as k, cast(p_size as varchar) as s, lower(p_type) as t from part"}


def functions(f: Facts):
    return extract.extract_functions(c_sources(f))


@add("s2_scan_files", "select distinct file as path, 'c' as language from sym union all select concat('src/',lower(c_mktsegment),'/s',c_custkey,'.py'), 'python' from customer where c_nationkey > 3")
def s2(f: Facts):
    k = F.col("c_custkey").cast("string")
    other = f.table("customer").select(F.lit(PROJECT).alias("project_id"), F.when(F.col("c_nationkey") > 3, F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/s"), k, F.lit(".py"))).otherwise(
        F.concat(F.lit("node_modules/s"), k, F.lit(".py"))).alias("path"))
    tree = f.files.select("project_id", "path").unionByName(other)
    return readers.scan_files(tree).select("path", "language")


@add("s3_scan_code_files", "select path from docall")
def s3(f: Facts):
    new = f.sources.select("project_id", "path")
    yaml = new.select("project_id", F.concat("path", F.lit(".yaml")).alias("path"))
    return readers.scan_code_files(new.unionByName(yaml)).select("path")


@add("s4_language_of", "select path, 'c' as language from docall union all select concat(path,'.rs'), 'rust' from docall union all select concat(path,'.xyz'), 'xyz' from docall")
def s4(f: Facts):
    from codefacts.functions.paths import language_of

    p = f.sources.select(F.explode(F.array("path", F.concat("path", F.lit(".rs")), F.concat("path", F.lit(".xyz")))).alias("path"))
    return p.withColumn("language", language_of("path"))


@add("s5_scan_includes", "select path as src, concat(t,'.h') as target, 1 as ord from cp", CP)
def s5(f: Facts):
    return readers.scan_includes(c_sources(f)).drop("project_id")


@add("s6_read_compile_commands", "select cast(p_partkey as varchar) as project_id, concat('src/',lower(p_type),'.c') as path from part union all select cast(p_partkey as varchar), concat('lib/',p_size,'.c') from part")
def s6(f: Facts):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('[{"directory": "/b", "file": "src\\\\'), F.lower("p_type"), F.lit('.c"}, {"file": "lib/'), F.col("p_size").cast("string"), F.lit('.c"}, {"file": ""}]'))
    return readers.read_compile_commands(f.table("part").select(k.alias("project_id"), text.alias("text"))).select("project_id", "path")


@add("s7_read_build_text", "select cast(p_partkey as varchar) as project_id, concat('src/',lower(p_type),'.c') as path from part union all select cast(p_partkey as varchar), concat('../x-',p_size,'.cpp') from part")
def s7(f: Facts):
    text = F.concat(F.lit("add_executable(app src/"), F.lower("p_type"), F.lit(".c\n  ../x-"), F.col("p_size").cast("string"), F.lit(".cpp)\n# none.h"))
    return readers.read_build_text(f.table("part").select(F.col("p_partkey").cast("string").alias("project_id"), text.alias("text"))).select("project_id", "path")


def keil(f: Facts):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    file = lambda n, p, x: F.concat(F.lit("<File><FileName>"), n, F.lit("</FileName><FilePath>"), p, F.lit("</FilePath>"), x, F.lit("</File>"))
    off = F.lit("<FileOption><CommonProperty><IncludeInBuild>0</IncludeInBuild></CommonProperty></FileOption>")
    group = F.concat(F.lit("<Groups><Group><GroupName>"), F.lower("p_type"), F.lit("</GroupName><Files>"), file(F.lit("a.c"), F.concat(F.lit("..\\src\\./a"), k, F.lit(".c")), F.lit("")),
                     file(F.lit("b.c"), F.lit("..\\..\\out\\b.c"), off), F.lit("</Files></Group></Groups>"))
    target = lambda n: F.concat(F.lit("<Target><TargetName>"), n, F.lit("</TargetName><TargetOption><TargetCommonOption><Device>D"), s, F.lit("</Device><Cpu>CPU"), s, F.lit(
        "</Cpu></TargetCommonOption><TargetArmAds><Cads><VariousControls><Define>A, B"), s, F.lit("</Define></VariousControls></Cads></TargetArmAds></TargetOption>"), group, F.lit("</Target>"))
    two = F.when(F.col("p_size") % 2 == 0, target(F.lit("T2"))).otherwise(F.lit(""))
    text = F.concat(F.lit("<Project><SelectTargetNo>1</SelectTargetNo><Targets>"), target(F.lit("T1")), two, F.lit("</Targets></Project>"))
    return f.table("part").select(k.alias("project_id"), text.alias("text"))


@add("s8_read_keil_project", """
select cast(p_partkey as varchar) as project_id, t as target, lower(p_type) as "group", path, compiled from part, (values ('T1'),('T2')) v(t), lateral (select concat('src/a',p_partkey,'.c') as path, true as compiled union all select 'b.c', false) x where t='T1' or p_size % 2=0""")
def s8(f: Facts):
    return readers.read_keil_project(keil(f), project_dir="MDK")[1]


@add("s9_pick_active_target", """
select cast(p_partkey as varchar) as project_id, case when p_size % 2=0 then 'T2' else 'T1' end as target, case when p_size % 2=0 then 2 else 1 end as targets, p_size % 2=1 or p_partkey % 3=0 as resolved from part""".replace("case when p_size % 2=0 then 'T2' else 'T1' end as target,", "case when p_size % 2=0 and p_partkey % 3<>0 then 'T2' else 'T1' end as target,"))
def s9(f: Facts):
    t = readers.read_keil_project(keil(f), project_dir="MDK")[0]
    chosen = f.table("part").select(F.col("p_partkey").cast("string").alias("project_id"), F.when(F.col("p_partkey") % 3 == 0, F.lit("T1")).alias("target"))
    return readers.pick_active_target(t, chosen)


@add("s10_resolve_project_path", "select p_partkey, concat('src/',lower(p_type),'.c') as inside, 'x.c' as outside, concat('y',p_size,'.c') as absolute from part")
def s10(f: Facts):
    from codefacts.functions.paths import resolve_project_path as r

    s = F.col("p_size").cast("string")
    return f.table("part").select("p_partkey", r(F.concat(F.lit("$PROJ_DIR$\\..\\src\\"), F.lower("p_type"), F.lit(".c")), F.lit("n.c"), F.lit("prj")).alias("inside"),
                                  r(F.lit("../../../x/x.c"), F.lit("x.c"), F.lit("prj")).alias("outside"), r(F.concat(F.lit("C:/a/"), s), F.concat(F.lit("y"), s, F.lit(".c")), F.lit("prj")).alias("absolute"))


@add("s11_read_iar_project", "select cast(p_partkey as varchar) as project_id, concat('src/',p_size,'.c') as path, true as compiled from part union all select cast(p_partkey as varchar), concat(lower(p_type),'.c'), false from part")
def s11(f: Facts):
    text = F.concat(F.lit("<project><group><name>g</name><file><name>$PROJ_DIR$\\src\\"), F.col("p_size").cast("string"), F.lit(".c</name></file></group><file><name>$PROJ_DIR$/"), F.lower("p_type"), F.lit(".c</name><excluded>yes</excluded></file></project>"))
    return readers.read_iar_project(f.table("part").select(F.col("p_partkey").cast("string").alias("project_id"), text.alias("text")))


@add("s12_pick_build_system", "select o_custkey as project_id, ['compile_commands','cmake','make','keil','iar'][min(o_orderkey % 5) + 1] as system from orders group by o_custkey")
def s12(f: Facts):
    names = F.array(*[F.lit(x) for x in ("compile_commands", "cmake", "make", "keil", "iar")])
    return readers.pick_build_system(f.table("orders").select(F.col("o_custkey").alias("project_id"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("system")))


def scope_texts(f: Facts):
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("# rules\nthird_party:\n  - path: 'Middlewares/"), F.lower("p_type"), F.lit("/**'\n    name: L"), s, F.lit("\n  - ext/lib\nignore:\n  - docs/"), s, F.lit("\nbuild:\n  target: T"), s, F.lit("\n"))
    return f.table("part").select(F.col("p_partkey").cast("string").alias("project_id"), text.alias("text"))


@add("s13_read_scope_rules", """
select cast(p_partkey as varchar) as project_id, kind, pattern, name from part, lateral (select 'third_party' as kind, concat('Middlewares/',lower(p_type),'/**') as pattern, concat('L',p_size) as name union all select 'third_party','ext/lib','lib'
 union all select 'ignore', concat('docs/',p_size), null union all select 'target', concat('T',p_size), null) x""")
def s13(f: Facts):
    return readers.read_scope_rules(scope_texts(f)).drop("ord")


@add("s14_write_scope_rules", """
select cast(p_partkey as varchar) as project_id, concat('third_party:\n  - path: Middlewares/',lower(p_type),'\n    name: L',p_size,'\n  - path: ext/lib\n    name: lib\nignore:\n  - docs/',p_size,'/**\nbuild:\n  target: T',p_size) as text from part""")
def s14(f: Facts):
    from codefacts.functions.paths import normalize_scope_path

    r = readers.read_scope_rules(scope_texts(f)).withColumn("pattern", normalize_scope_path("pattern"))
    return readers.scope_rules_text(r)


@add("s21_read_call_trace", """
select event_type as model, count(*) as calls, count(*) filter (where value > 50) as errors, cast(sum(event_id) as bigint) as prompt_tokens, cast(sum(user_id) as bigint) as completion_tokens from events group by event_type""")
def s21(f: Facts):
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("trace_id"), F.when(F.col("value") > 50, "error").otherwise("ok").alias("status"), F.col("event_type").alias("model"),
                              F.struct(F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens")).alias("usage")))
    lines = f.table("events").select(F.explode(F.array(F.concat(F.lit("INFO llm_trace "), body), F.lit("INFO other line"))).alias("value"))
    return readers.usage_by_model(readers.read_call_trace(lines))


@add("x1_extract_macros", "select path, concat('MAX_',k) as name, 'constant' as kind, 2 as line, s as value from cp", CP)
def x1(f: Facts):
    return extract.extract_macros(c_sources(f)).drop("project_id", "value_expr")


@add("x2_extract_enum_members", """
select path, concat('E',k) as enum, concat(l,k) as name, pos, value, value_expr from cp, lateral (select 'A' as l, 0 as pos, '0' as value, null as value_expr union all select 'B',1,s,null union all select 'C',2,cast(p_size+1 as varchar),null
 union all select 'D',3,null,'X + 1' union all select 'F',4,null,null) x""", CP)
def x2(f: Facts):
    return extract.extract_enum_members(c_sources(f)).drop("project_id")


@add("x3_extract_struct_fields", """
select path, concat('S',k) as struct, name, pos, type, fp as is_function_pointer from cp, lateral (select t as name, 0 as pos, 'int' as type, false as fp union all select 'name',1,concat('char[',s,']'),false union all select 'cb',2,'void (*)(int)',true) x""", CP)
def x3(f: Facts):
    return extract.extract_struct_fields(c_sources(f)).drop("project_id")


@add("x4_extract_functions", "select path, concat('run_',k) as name, 9 as start_line, 15 as end_line, 'static int' as return_type, 'p,n' as parameters, true as definition from cp", CP)
def x4(f: Facts):
    return functions(f).drop("project_id").withColumn("parameters", F.array_join("parameters", ","))


@add("x5_extract_bindings", """
select path, line, concat('on_',k) as name, via, field, concat('run_',k) as caller_hint from cp, lateral (select 12 as line, 'field_assign' as via, 'cb' as field union all select 13,'register_call','') x
 union all select path, 10, 'n', 'field_assign', t, concat('run_',k) from cp""", CP)
def x5(f: Facts):
    return extract.extract_bindings(c_sources(f)).drop("project_id")


@add("x6_extract_field_usage", "select path, line, field, access, concat('run_',k) as function from cp, lateral (select 10 as line, t as field, 'write' as access union all select 11,t,'read' union all select 12,'cb','write') x", CP)
def x6(f: Facts):
    return extract.extract_field_usage(c_sources(f)).drop("project_id")


@add("x7_file_size_guard", "select doc_id, concat('file too large: ',strlen(text),' bytes') as error from documents where strlen(text) > 10000")
def x7(f: Facts):
    docs = f.table("documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("path"), "text")
    return extract.size_guard(docs, limit=10_000)[1].select(F.col("path").alias("doc_id"), "error")


SHAPES = [
    "typedef struct tag_K {\n  struct { int q; } inner;\n  void (*cb)(int, char *);\n  char buf[S]; /* }; */\n} T_K;",
    "static unsigned int\nrun_K(int a,\n    char *b)\n{\n  if (a) {\n    b[0] = 1;\n  }\n}",
    "void go_K(void) {\n  register_a(wrap(x), &on_K); attach(two_K, 3); log(p->a.b);\n}",
    "static const struct ops o_K = {\n  .open = open_K,\n  [2] = third_K,\n};\nfp list_K[] = { one_K, { &two_K } };",
    "int f_K(int n) {\n  /* } */ char *s = \"}\"; // {\n  p->v += n; q.w++;\n  p->x = p->y = h_K;\n}",
    "#ifdef A\n#define B {\n#endif\nextern \"C\" {\nint proto_K(int (*fn)(int), int n[3]);\n}\nstruct n_K { int a, b; };",
]


def c_shapes(f: Facts):
    """One C text per part, in six shapes: nested and multi-line declarations, calls in calls, tables, brackets in comments and strings."""
    k = F.col("p_partkey")
    shape = F.get(F.array(*[F.lit(x) for x in SHAPES]), (k % 6).cast("int"))
    text = F.replace(F.replace(shape, F.lit("_K"), F.concat(F.lit("_"), k.cast("string"))), F.lit("[S]"), F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("]")))
    return spread(f).select(F.lit(PROJECT).alias("project_id"), F.concat(F.lit("shape/p"), k.cast("string"), F.lit(".c")).alias("path"), text.alias("text"))


SHAPED = {"sp": "select p_partkey % 6 as shape, cast(p_partkey as varchar) as k, cast(p_size as varchar) as s, concat('shape/p',p_partkey,'.c') as path from part"}


@add("x3_struct_shapes", """
select path, concat('T_',k) as struct, name, pos, type, fp as is_function_pointer from sp, lateral (select 'inner' as name, 0 as pos, 'struct { int q; }' as type, false as fp union all select 'cb',1,'void (*)(int, char *)',true
 union all select 'buf',2,concat('char[',s,']'),false) x where shape=0 union all select path, concat('n_',k), 'a', 0, 'int', false from sp where shape=5""", SHAPED)
def x3s(f: Facts):
    return extract.extract_struct_fields(c_shapes(f)).drop("project_id")


@add("x4_function_shapes", """
select path, concat(n,'_',k) as name, a as start_line, z as end_line, r as return_type, p as parameters, d as definition from sp join (values (1,'run',1,8,'static unsigned int','a,b',true),(2,'go',1,3,'void','',true),
 (4,'f',1,5,'int','n',true),(5,'proto',5,5,'int','fn,n',false)) v(shape,n,a,z,r,p,d) using (shape)""", SHAPED)
def x4s(f: Facts):
    return extract.extract_functions(c_shapes(f)).drop("project_id").withColumn("parameters", F.array_join("parameters", ","))


@add("x5_binding_shapes", """
select path, line, concat(n,'_',k) as name, via, field, case when h <> '' then concat(h,'_',k) end as caller_hint from sp join (values (2,2,'on','register_call','','go'),(2,2,'two','register_call','','go'),(3,2,'open','field_assign','',''),
 (3,3,'third','field_assign','',''),(3,5,'one','table_assign','',''),(3,5,'two','table_assign','',''),(4,4,'h','field_assign','y','f')) v(shape,line,n,via,field,h) using (shape)""", SHAPED)
def x5s(f: Facts):
    return extract.extract_bindings(c_shapes(f)).drop("project_id")


@add("x6_usage_shapes", """
select path, line, field, access, concat(h,'_',k) as function from sp join (values (2,2,'a','read','go'),(2,2,'b','read','go'),(4,3,'v','write','f'),(4,3,'w','read','f'),(4,4,'x','write','f'),(4,4,'y','write','f'))
 v(shape,line,field,access,h) using (shape)""", SHAPED)
def x6s(f: Facts):
    return extract.extract_field_usage(c_shapes(f)).drop("project_id")
