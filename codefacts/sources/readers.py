"""Readers: code graph, source trees, build projects, scope rules, call traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codefacts.functions import fixed
from codefacts.functions.paths import is_code_file, is_scanned_file, language_of, resolve_project_path, scope_name_of, suffix_of, unquote

NODE_COLUMNS = ["id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "signature"]
EDGE_COLUMNS = ["source", "target", "kind", "metadata", "line", "col"]
BUILD_ORDER = ["compile_commands", "cmake", "ninja", "make", "keil", "iar", "stm32_ioc"]


def read_code_graph(spark: SparkSession, folder: str, project_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges exported as Parquet; a missing table or column is an error."""
    out = []
    for name, cols in (("nodes", NODE_COLUMNS), ("edges", EDGE_COLUMNS)):
        df = spark.read.parquet(f"{folder}/{name}")
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"table {name} lacks the columns {missing}")
        out.append(df.select(F.lit(project_id).alias("project_id"), *cols))
    return out[0], out[1]


def read_tree(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """All files below a folder with relative path, bytes and size; one row per file, read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return raw.select(F.lit(project_id).alias("project_id"), rel.alias("path"), "content", F.col("length").alias("size"))


def scan_files(tree: DataFrame) -> DataFrame:
    """Files of the index: known suffixes or configuration names outside skipped folders, with their language."""
    return tree.where(is_scanned_file("path")).withColumn("language", language_of("path"))


def scan_code_files(tree: DataFrame) -> DataFrame:
    return tree.where(is_scanned_file("path") & is_code_file("path"))


def source_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """``(project_id, path, line, content)``, lines counted from 1; whole texts."""
    return files.select("project_id", "path", F.posexplode(F.split(text, r"\r?\n")).alias("p", "content")).select("project_id", "path", (F.col("p") + 1).alias("line"), "content")


def scan_includes(files: DataFrame, text: str = "text") -> DataFrame:
    """Include lines of C files in order; targets are the raw text between the quotes or brackets."""
    lines = source_lines(files.where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(fixed.INCLUDE_SUFFIXES)), text)
    target = F.regexp_extract("content", r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""", 1)
    return lines.select("project_id", F.col("path").alias("src"), target.alias("target"), F.col("line").alias("ord")).where("target <> ''")


def read_compile_commands(docs: DataFrame, text: str = "text") -> DataFrame:
    """Compiled files of a ``compile_commands.json`` text; unreadable JSON gives no row."""
    entries = F.from_json(F.col(text), "array<struct<file:string>>")
    file = F.replace(F.col("e.file"), F.lit("\\"), F.lit("/"))
    return docs.select("project_id", F.explode(entries).alias("e")).select("project_id", file.alias("path"), F.lit(True).alias("compiled")).where("path <> ''")


def read_build_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every C or C++ file name inside a CMake, Ninja or Make text is a compiled file."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"([\w./-]+\.(?:cpp|cc|c))"), F.lit(1))
    return docs.select("project_id", F.explode(found).alias("path"), F.lit(True).alias("compiled"))


_FILE = "struct<FileName:string,FilePath:string,FileOption:struct<CommonProperty:struct<IncludeInBuild:string>>>"
KEIL = (
    "SelectTargetNo string, Targets struct<Target:array<struct<TargetName:string,TargetOption:struct<TargetCommonOption:struct<Device:string,Cpu:string>,"
    "TargetArmAds:struct<Cads:struct<VariousControls:struct<Define:string>>>>,Groups:struct<Group:array<struct<GroupName:string,Files:struct<File:array<" + _FILE + ">>>>>>>>"
)


def read_keil_project(docs: DataFrame, text: str = "text", project_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """Targets and files of build-project XML texts; unreadable XML gives no row.

    Targets: ``(project_id, target, pos, selected, cpu, device, defines)``; files: ``(project_id, target, group, path,
    compiled)`` with paths relative to the root.
    """
    parsed = docs.select("project_id", F.from_xml(F.col(text), KEIL, {"mode": "PERMISSIVE"}).alias("x"))
    t = parsed.select("project_id", F.col("x.SelectTargetNo").try_cast("int").alias("selected"), F.posexplode("x.Targets.Target").alias("pos", "t"))
    name = F.coalesce(F.nullif(F.trim("t.TargetName"), F.lit("")), F.lit("default"))
    common = "t.TargetOption.TargetCommonOption"
    defines = F.filter(F.transform(F.split(F.coalesce("t.TargetOption.TargetArmAds.Cads.VariousControls.Define", F.lit("")), ","), lambda d: F.trim(d)), lambda d: d != "")
    targets = t.select("project_id", name.alias("target"), "pos", "selected", F.trim(f"{common}.Cpu").alias("cpu"), F.trim(f"{common}.Device").alias("device"), defines.alias("defines"))
    g = t.select("project_id", name.alias("target"), F.explode("t.Groups.Group").alias("g")).select("project_id", "target", F.col("g.GroupName").alias("group"), F.explode("g.Files.File").alias("f"))
    path = resolve_project_path(F.col("f.FilePath"), F.col("f.FileName"), F.lit(project_dir))
    included = F.coalesce(F.trim("f.FileOption.CommonProperty.IncludeInBuild"), F.lit("1")) != "0"
    return targets, g.select("project_id", "target", "group", path.alias("path"), included.alias("compiled")).where("path <> ''")


def pick_active_target(targets: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Active target per project: the chosen name, else the selected number, else the first.

    ``resolved`` is false when there are several targets and none was chosen.
    """
    t = targets.join(chosen.select("project_id", F.col("target").alias("_c")), "project_id", "left") if chosen is not None else targets.withColumn("_c", F.lit(None).cast("string"))
    rank = F.when(F.col("target") == F.col("_c"), 0).when(F.col("pos") == F.col("selected"), 1).otherwise(2)
    best = t.groupBy("project_id").agg(F.min_by("target", F.struct(rank, "pos")).alias("target"), F.count("*").alias("targets"), F.bool_or(F.col("target") == F.col("_c")).alias("_has"))
    return best.select("project_id", "target", "targets", ((F.col("targets") == 1) | F.coalesce("_has", F.lit(False))).alias("resolved"))


IAR = "configuration struct<settings:struct<Cpu:struct<Name:string>>>, group array<struct<name:string,file:array<struct<name:string,excluded:string>>>>, file array<struct<name:string,excluded:string>>"


def read_iar_project(docs: DataFrame, text: str = "text") -> DataFrame:
    """Files of IAR project texts; ``<excluded>yes</excluded>`` takes a file out of the build."""
    x = docs.select("project_id", F.from_xml(F.col(text), IAR).alias("x"))
    empty = F.array().cast("array<struct<name:string,excluded:string>>")
    files = F.concat(F.coalesce("x.file", empty), F.coalesce(F.flatten("x.group.file"), empty))
    name = F.regexp_replace(F.replace(F.replace(F.trim("f.name"), F.lit("$PROJ_DIR$"), F.lit("")), F.lit("\\"), F.lit("/")), r"^/+", "")
    return x.select("project_id", F.explode(files).alias("f")).select("project_id", name.alias("path"), (F.coalesce(F.trim("f.excluded"), F.lit("")) != "yes").alias("compiled")).where("path <> ''")


def pick_build_system(found: DataFrame) -> DataFrame:
    """First system of each project in the order of precedence: ``found(project_id, system)``; an empty compile
    database must not be listed."""
    rank = F.array_position(F.array(*[F.lit(s) for s in BUILD_ORDER]), F.col("system"))
    return found.where(rank > 0).groupBy("project_id").agg(F.min_by("system", rank).alias("system"))


def pick_project_file(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Project file of each repository: top level, then the usual folders in order, then the shallowest."""
    known = ["Projects", "project", "prj", "MDK-ARM", "Keil", "EWARM", "build"]
    parts = F.split("path", "/")
    place = F.array_position(F.array(*[F.lit(k) for k in known]), parts[0])
    rank = F.when(F.size(parts) == 1, 0).when((F.size(parts) == 2) & (place > 0), place).otherwise(100 + F.size(parts))
    return files.where(suffix_of("path").isin(suffixes)).groupBy("project_id").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def read_scope_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(project_id, kind, ord, pattern, name)`` from scope configuration texts.

    Sections project, third_party, ignore and build; list items are rules, ``path:``/``name:`` lines complete a
    library, ``target:`` names the build target (kind target). A project section without items is a white list that
    holds nothing: a rule of kind project without a pattern.
    """
    raw = docs.select("project_id", F.posexplode(F.split(text, r"\r?\n")).alias("ord", "l")).withColumn("l", F.trim("l")).where("l <> '' and not startswith(l, '#')")
    w = Window.partitionBy("project_id").orderBy("ord")
    head = F.endswith("l", F.lit(":")) & ~F.startswith("l", F.lit("-"))
    word = F.trim(F.regexp_replace("l", ":$", ""))
    known = F.when(head & word.isin("project", "third_party", "ignore", "build"), word)
    rows = raw.withColumn("section", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~head)
    item = F.startswith("l", F.lit("-"))
    body = F.trim(F.regexp_replace("l", "^-", ""))
    key, value = F.trim(F.regexp_extract(body, r"^([A-Za-z_]+)\s*:", 1)), unquote(F.regexp_extract(body, r"^[A-Za-z_]+\s*:\s*(.*)$", 1))
    rows = rows.withColumn("item", item).withColumn("key", key).withColumn("value", value).withColumn("body", unquote(body))
    plain = rows.where("item and section in ('ignore','project')").select("project_id", F.col("section").alias("kind"), "ord", F.col("body").alias("pattern"), F.lit(None).cast("string").alias("name"))
    lib = rows.where("section = 'third_party'").withColumn("no", F.sum(F.col("item").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    path = F.max(F.when(F.col("key") == "path", F.col("value")).when(F.col("item") & (F.col("key") == ""), F.col("body")))
    libs = lib.groupBy("project_id", "no").agg(F.min("ord").alias("ord"), path.alias("pattern"), F.max(F.when(F.col("key") == "name", F.col("value"))).alias("name")).where("coalesce(pattern, '') <> ''")
    libs = libs.select("project_id", F.lit("third_party").alias("kind"), "ord", "pattern", scope_name_of(F.regexp_replace("pattern", r"/+\*\*$", ""), F.col("name")).alias("name"))
    target = rows.where("section = 'build' and key = 'target' and value <> ''").select("project_id", F.lit("target").alias("kind"), "ord", F.col("value").alias("pattern"), F.lit(None).cast("string").alias("name"))
    bare = raw.where(head & (word == "project")).groupBy("project_id").agg(F.min("ord").alias("ord")).join(plain.where("kind = 'project'"), "project_id", "left_anti")
    none = F.lit(None).cast("string")
    return plain.unionByName(libs).unionByName(target).unionByName(bare.select("project_id", F.lit("project").alias("kind"), "ord", none.alias("pattern"), none.alias("name")))


def read_legacy_ignore(docs: DataFrame, text: str = "text") -> DataFrame:
    """Ignore rules of older files: the list items that follow ``ignore:``, up to the first line that is none."""
    raw = docs.select("project_id", F.posexplode(F.split(text, r"\r?\n")).alias("ord", "l")).withColumn("l", F.trim(F.regexp_replace("l", "^\ufeff", ""))).where("l <> '' and not startswith(l, '#')")
    w = Window.partitionBy("project_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    item, head = F.startswith("l", F.lit("-")), F.startswith("l", F.lit("ignore:"))
    # an item counts while the last line that is no item opened the list
    rows = raw.withColumn("_in", F.last(F.when(~item, head), ignorenulls=True).over(w)).where("_in")
    pattern = F.trim(F.regexp_replace(F.when(head, F.substr("l", F.lit(8))).otherwise(F.col("l")), r"^\s*-", ""))
    listed = rows.where(item | F.rlike("l", F.lit(r"^ignore:\s*-"))).select("project_id", F.lit("ignore").alias("kind"), "ord", pattern.alias("pattern"), F.lit(None).cast("string").alias("name"))
    return listed.where("pattern <> ''")


def load_scope_rules(configs: DataFrame, legacy: DataFrame) -> DataFrame:
    """Rules of every project: its configuration where there is one, else its older ignore file; both ``(project_id, text)``."""
    return read_scope_rules(configs).unionByName(read_legacy_ignore(legacy.join(configs.select("project_id").distinct(), "project_id", "left_anti")))


def detect_build_systems(files: DataFrame, compiled: DataFrame) -> DataFrame:
    """Build systems that the files of a project show, for ``pick_build_system``.

    ``files(project_id, path)``; ``compiled`` is ``read_compile_commands`` of the compile databases: an empty one does not
    count. CMake, Ninja, Make and the pin configuration are looked for at the top, Keil and IAR projects anywhere.
    """
    top = {"CMakeLists.txt": "cmake", "build.ninja": "ninja", "Makefile": "make"}
    suffix, at_top = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), ~F.contains("path", F.lit("/"))
    system = F.lit(None).cast("string")
    for name, found in top.items():
        system = F.when(F.col("path") == name, found).otherwise(system)
    system = F.when(suffix.isin(".uvprojx", ".uvproj"), "keil").when(suffix == ".ewp", "iar").when(at_top & (suffix == ".ioc"), "stm32_ioc").otherwise(system)
    shown = files.select("project_id", system.alias("system")).where("system is not null")
    return shown.unionByName(compiled.select("project_id", F.lit("compile_commands").alias("system"))).distinct()


def scope_rules_text(rules: DataFrame) -> DataFrame:
    """Canonical configuration text per project from chosen rules; readable by ``read_scope_rules``."""
    name = scope_name_of("pattern", F.col("name"))
    line = F.when(F.col("kind") == "third_party", F.concat(F.lit("  - path: "), "pattern", F.lit("\n    name: "), name)).when(F.col("kind") == "ignore", F.concat(F.lit("  - "), "pattern", F.lit("/**"))).otherwise(
        F.concat(F.lit("  target: "), "pattern"))
    agg = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", line.alias("l"))))), lambda x: x["l"]), "\n")
    j = rules.groupBy("project_id").agg(agg("third_party").alias("t"), agg("ignore").alias("i"), agg("target").alias("b"))
    part = lambda c, h: F.when(F.col(c) != "", F.concat(F.lit(h + ":\n"), c))
    return j.select("project_id", F.concat_ws("\n", part("t", "third_party"), part("i", "ignore"), part("b", "build")).alias("text"))


TRACE = T.StructType([
    T.StructField("trace_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("category", T.StringType()), T.StructField("status_code", T.IntegerType()),
    T.StructField("usage", T.StructType([T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType())])),
])


def read_call_trace(lines: DataFrame, text: str = "value") -> DataFrame:
    """Model-call records from log lines that hold ``llm_trace {json}``; other lines are skipped."""
    raw = F.regexp_extract(text, r"llm_trace (\{.*\})\s*$", 1)
    return lines.select(F.from_json(F.nullif(raw, F.lit("")), TRACE).alias("t")).where("t.trace_id is not null").select(
        "t.trace_id", "t.status", "t.latency_ms", "t.provider", "t.model", "t.category", "t.status_code", F.col("t.usage.prompt_tokens").alias("prompt_tokens"), F.col("t.usage.completion_tokens").alias("completion_tokens"))


def usage_by_model(trace: DataFrame) -> DataFrame:
    return trace.groupBy("model").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


