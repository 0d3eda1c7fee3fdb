"""Scope and build classification of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import fixed
from codefacts.functions.paths import (
    base_name, ignore_regex, norm_build_path, normalize_scope_path, path_suffixes, scope_name_of, slashes,
    suffix_of, top_dir,
)
from codefacts.functions.records import compile_rank
from codefacts.operators.closure import closure
from codefacts.operators.substrings import contains_pairs

STATUS_ORDER = ["compiled", "excluded", "not_in_project", "unknown"]


def compile_rules(rules: DataFrame) -> DataFrame:
    """One row per project from ``rules(project_id, kind, ord, pattern, name)``.

    All ignore patterns become one alternation, so a file is matched once and the pattern is compiled once per
    project. The lists hold the lines of one configuration file, which bounds them.
    """
    rx = F.concat(F.lit("(?:"), ignore_regex("pattern"), F.lit(")"))
    base = normalize_scope_path("pattern")

    def joined(kind: str) -> Column:
        found = F.concat_ws("|", F.collect_list(F.when(F.col("kind") == kind, rx)))
        return F.nullif(found, F.lit(""))

    library = F.when(
        (F.col("kind") == "third_party") & (base != ""),
        F.struct("ord", base.alias("path"), scope_name_of(base, F.col("name")).alias("name")),
    )
    return rules.groupBy("project_id").agg(
        joined("ignore").alias("ignore_rx"), joined("project").alias("include_rx"),
        F.coalesce(F.bool_or(F.col("kind") == "project"), F.lit(False)).alias("include_set"),
        F.sort_array(F.collect_list(library)).alias("libraries"),
    )


def scope_columns(path: Column) -> tuple[Column, Column]:
    """(scope_type, scope_name) of a path against the columns of ``compile_rules``.

    Ignore wins over third_party, which wins over the include whitelist; with a whitelist anything outside it is
    ignored.
    """
    p = F.regexp_replace(slashes(path), r"^/+|/+$", "")
    ignored = F.coalesce(F.rlike(p, F.col("ignore_rx")), F.lit(False))
    hit = F.try_element_at(
        F.filter(F.col("libraries"), lambda t: (p == t["path"]) | F.startswith(p, F.concat(t["path"], F.lit("/")))),
        F.lit(1),
    )
    included = F.coalesce(F.rlike(p, F.col("include_rx")), F.lit(False))
    kind = (
        F.when(ignored, "ignored").when(hit.isNotNull(), "third_party")
        .when(F.coalesce(F.col("include_set"), F.lit(False)) & ~included, "ignored").otherwise("project")
    )
    return kind, F.when(~ignored, hit["name"])


def classify_scope(files: DataFrame, rules: DataFrame, path: str = "path", keep_ignored: bool = False) -> DataFrame:
    """Adds scope_type and scope_name; ignored files are dropped unless asked for."""
    kind, name = scope_columns(F.col(path))
    rule_cols = ["ignore_rx", "include_rx", "include_set", "libraries"]
    keep = [c for c in files.columns if c not in ("scope_type", "scope_name")]
    out = (
        files.join(compile_rules(rules), "project_id", "left")
        .select(*keep, kind.alias("scope_type"), name.alias("scope_name"), *rule_cols).drop(*rule_cols)
    )
    return out if keep_ignored else out.where(F.col("scope_type") != "ignored")


def build_boundary(compiled: DataFrame, includes: DataFrame, available: DataFrame) -> DataFrame:
    """Files inside the build: compiled files, their same-stem headers that exist, and all they include.

    ``compiled(project_id, path)``, ``includes(project_id, src, target)``, ``available(project_id, path)``.
    """
    source = suffix_of("path").isin(".c", ".cc", ".cpp", ".cxx")
    header = F.regexp_replace("path", r"\.[^./]+$", ".h")
    headers = compiled.where(source).select("project_id", header.alias("path")).join(
        available, ["project_id", "path"], "left_semi"
    )
    edges = includes.join(
        available.withColumnRenamed("path", "target"), ["project_id", "target"], "left_semi"
    ).select("project_id", F.col("src"), F.col("target").alias("dst"))
    starts = compiled.unionByName(headers).withColumnRenamed("path", "node")
    return closure(starts.select("project_id", "node"), edges.distinct(), ["project_id"]).withColumnRenamed("node", "path")


def classify_build_scope(files: DataFrame, rules: DataFrame, boundary: DataFrame, builds: DataFrame) -> DataFrame:
    """Scope first; inside a resolved build a project file outside the boundary is ``non_build``.

    ``builds(project_id, resolved)``.
    """
    inside = boundary.select("project_id", "path").distinct().withColumn("_in", F.lit(True))
    scoped = classify_scope(files, rules)
    out = scoped.join(inside, ["project_id", "path"], "left").join(builds, "project_id", "left")
    outside = (F.col("scope_type") == "project") & F.coalesce("resolved", F.lit(False)) & F.col("_in").isNull()
    return out.withColumn("scope_type", F.when(outside, "non_build").otherwise(F.col("scope_type"))).drop("_in", "resolved")


def scope_preview(files: DataFrame, old_rules: DataFrame, new_rules: DataFrame) -> DataFrame:
    """Per file the class before and after a rule change, and whether it moves."""
    keys = ["project_id", "path"]
    before = classify_scope(files.select(*keys), old_rules, keep_ignored=True).select(*keys, F.col("scope_type").alias("before"))
    after = classify_scope(files.select(*keys), new_rules, keep_ignored=True).select(*keys, F.col("scope_type").alias("after"))
    return before.join(after, keys, "full_outer").withColumn("moved", ~F.col("before").eqNullSafe(F.col("after")))


def compile_status(files: DataFrame, build_files: DataFrame, builds: DataFrame) -> DataFrame:
    """compiled > excluded > not_compiled (when the project has a build configuration) > unknown, by base name.

    ``build_files(project_id, path, compiled)``, ``builds(project_id, has_build_config)``.
    """
    flags = build_files.groupBy("project_id", base_name("path").alias("_base")).agg(
        F.bool_or("compiled").alias("_c"), F.bool_or(~F.col("compiled")).alias("_x")
    )
    status = (
        F.when(F.col("_c"), "compiled").when(F.col("_x"), "excluded")
        .when(F.col("has_build_config"), "not_compiled").otherwise("unknown")
    )
    return (
        files.withColumn("_base", base_name("path")).join(flags, ["project_id", "_base"], "left")
        .join(builds.select("project_id", "has_build_config"), "project_id", "left")
        .withColumn("compile_status", status).drop("_base", "_c", "_x", "has_build_config")
    )


def build_query(asked: DataFrame, build_files: DataFrame) -> DataFrame:
    """Build membership of asked paths: exact, base name, or part of a listed path.

    ``asked(project_id, path)``, ``build_files(project_id, path, compiled)``. A listed path that contains the asked
    one also covers the suffix form.
    """
    listed = build_files.select("project_id", norm_build_path("path").alias("listed"), "compiled").distinct()
    wanted = asked.select("project_id", "path", norm_build_path("path").alias("needle"), F.lower(F.substring_index("path", "/", -1)).alias("base"))
    inside = contains_pairs(wanted, "needle", listed, "listed", ["project_id"]).join(listed, ["project_id", "listed"])
    by_path = wanted.join(inside, ["project_id", "needle"]).select("project_id", "path", "compiled")
    by_base = wanted.join(listed, (wanted["project_id"] == listed["project_id"]) & (wanted["base"] == listed["listed"])).select(
        wanted["project_id"], "path", "compiled"
    )
    hits = by_path.unionByName(by_base).groupBy("project_id", "path").agg(
        F.bool_or("compiled").alias("c"), F.bool_or(~F.col("compiled")).alias("x")
    )
    known = build_files.groupBy("project_id").agg(F.lit(True).alias("known"))
    c, x = F.coalesce("c", F.lit(False)), F.coalesce("x", F.lit(False))
    status = (
        F.when(F.col("known").isNull(), "unknown").when(c & ~x, "compiled").when(x, "excluded").otherwise("not_in_project")
    )
    return (
        asked.select("project_id", "path").distinct().join(hits, ["project_id", "path"], "left")
        .join(known, "project_id", "left")
        .select("project_id", "path", (c | x).alias("exists"), (c & ~x).alias("compiled"), (x & ~c).alias("excluded"), status.alias("status"))
    )


def suggest_scopes(files: DataFrame, cpus: DataFrame) -> DataFrame:
    """Suggested rules per directory: ``(project_id, kind, path, reason)``.

    ``files(project_id, path)``; ``cpus(project_id, dir, cpu)`` holds the CPU of each build project, with an empty
    ``dir`` for the main one. Ignore reasons are tried in order: another CPU, mostly Python, telling name. A library
    directory is replaced by its library sub-directories when it has any.
    """
    parts = F.split("path", "/")
    rows = files.select("project_id", "path", parts.alias("p"), suffix_of("path").alias("s")).where(
        (F.size("p") > 1) & ~F.startswith(F.col("p")[0], F.lit("."))
    )
    counted = rows.groupBy("project_id", F.col("p")[0].alias("dir")).agg(
        F.count_if(F.col("s").isin(".c", ".h", ".cpp", ".hpp", ".cc", ".py", ".ts", ".js")).alias("sources"),
        F.count_if(F.col("s") == ".py").alias("py"),
    )
    main = cpus.where(F.col("dir") == "").groupBy("project_id").agg(F.min("cpu").alias("main_cpu"))
    own = cpus.where(F.col("dir") != "").groupBy("project_id", "dir").agg(F.min("cpu").alias("own_cpu"))
    ratio = F.when(F.col("sources") > 0, F.col("py") / F.col("sources")).otherwise(0.0)
    reason = (
        F.when(F.col("own_cpu") != F.col("main_cpu"), "other_cpu").when((ratio > 0.8) & (F.col("py") >= 2), "python_tools")
        .when(F.lower("dir").isin(fixed.SUGGEST_IGNORE_DIRS), "name")
    )
    ignored = (
        counted.join(main, "project_id", "left").join(own, ["project_id", "dir"], "left")
        .withColumn("reason", reason).where(F.col("reason").isNotNull())
        .select("project_id", F.lit("ignore").alias("kind"), F.col("dir").alias("path"), "reason")
    )

    def library(col: Column) -> Column:
        low = F.lower(col)
        return low.isin(fixed.SUGGEST_LIBRARY_DIRS) | F.rlike(low, F.lit("^(?:" + "|".join(fixed.SUGGEST_LIBRARY_PREFIXES) + ")"))

    subs = (
        rows.where(F.size("p") > 2).select("project_id", F.col("p")[0].alias("dir"), F.col("p")[1].alias("sub")).distinct()
        .where(library(F.col("sub")) & ~F.startswith("sub", F.lit(".")))
    )
    tops = rows.select("project_id", F.col("p")[0].alias("dir")).distinct().where(library(F.col("dir"))).join(
        subs, ["project_id", "dir"], "left_anti"
    )
    found = subs.select("project_id", F.concat_ws("/", "dir", "sub").alias("path")).unionByName(
        tops.select("project_id", F.col("dir").alias("path"))
    )
    return ignored.unionByName(
        found.select("project_id", F.lit("third_party").alias("kind"), "path", F.lit("library_dir").alias("reason"))
    )


def ignored_top_dirs(rules: DataFrame) -> DataFrame:
    """Distinct slash-less ignore entries per project."""
    bare = F.regexp_replace(slashes("pattern"), r"^/+|/+$", "")
    return (
        rules.where((F.col("kind") == "ignore") & (bare != "") & ~F.contains(bare, F.lit("/")))
        .select("project_id", bare.alias("dir")).distinct()
    )


def count_source_files(files: DataFrame, index_dir: str) -> DataFrame:
    """C and C++ files per project outside hidden folders and the index folder."""
    top = top_dir("path")
    wanted = suffix_of("path").isin(".c", ".h", ".cpp", ".hpp", ".cc", ".cxx") & ~F.startswith("path", F.lit("."))
    return files.where(wanted & ~F.endswith(top, F.lit(index_dir))).groupBy("project_id").agg(F.count("*").alias("n"))


def best_status(paths: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Best compile status over the known files of each group of ``paths(keys…, path)``."""
    from codefacts.functions.records import compile_from_rank

    known = paths.join(files.select("project_id", "path", "compile_status"), ["project_id", "path"])
    return known.groupBy(*keys).agg(compile_from_rank(F.min(compile_rank("compile_status"))).alias("compile_status"))


def unique_match(asked: DataFrame, files: DataFrame, ask: str = "ask") -> DataFrame:
    """Asked paths matched to files: equal, else the only file ending in ``/ask``, else the only equal base name.

    Adds ``path`` and ``match`` (exact, suffix or base). Suffixes come from exploding every file path once.
    """
    clean = F.regexp_replace(slashes(ask), r"^[./]+", "")
    want = asked.select("project_id", ask).distinct().withColumn("_a", clean).withColumn("_b", base_name(clean))
    have = files.select("project_id", F.col("path")).distinct()
    exact = have.select("project_id", F.col("path").alias("_a"), F.col("path").alias("exact"))
    tails = have.select("project_id", "path", F.explode(path_suffixes("path")).alias("_a")).where(F.col("_a") != F.col("path"))
    tail = tails.groupBy("project_id", "_a").agg(F.count("*").alias("_n"), F.min("path").alias("tail")).where("_n = 1").drop("_n")
    bases = have.groupBy("project_id", base_name("path").alias("_b")).agg(F.count("*").alias("_n"), F.min("path").alias("only"))
    only = bases.where("_n = 1").drop("_n")
    j = want.join(exact, ["project_id", "_a"], "left").join(tail, ["project_id", "_a"], "left").join(only, ["project_id", "_b"], "left")
    match = F.when(F.col("exact").isNotNull(), "exact").when(F.col("tail").isNotNull(), "suffix").when(F.col("only").isNotNull(), "base")
    return j.select("project_id", ask, F.coalesce("exact", "tail", "only").alias("path"), match.alias("match"))


