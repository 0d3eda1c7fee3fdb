"""File changes, freshness and the choice between incremental and full refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import fixed
from codefacts.functions.paths import is_build_config, is_code_file, is_header, is_high_risk_header, path_suffixes
from codefacts.operators.closure import closure

KEYS = ["project_id", "path"]


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(project_id, path, change)`` with change modified, added or removed, from two hash tables."""
    a = old.select(*KEYS, F.col("content_hash").alias("_o"))
    b = new.select(*KEYS, F.col("content_hash").alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified")
    return a.join(b, KEYS, "full_outer").select(*KEYS, kind.alias("change")).where("change is not null")


def change_level(changes: DataFrame, projects: DataFrame) -> DataFrame:
    """L0 without changes, L4 when a build configuration changed, else L3, per project, with the counts."""
    agg = changes.groupBy("project_id").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("modified", "added", "removed")],
        F.bool_or(is_build_config("path")).alias("_cfg"))
    out = projects.select("project_id").distinct().join(agg, "project_id", "left").fillna(0, ["modified", "added", "removed"])
    level = F.when(F.col("_cfg").isNull(), "L0").when(F.col("_cfg"), "L4").otherwise("L3")
    return out.select("project_id", level.alias("level"), "modified", "added", "removed")


def change_impact(changes: DataFrame) -> DataFrame:
    """Impact label of each changed file: L4 build configuration, L3 added or removed, L1 modified."""
    label = F.when(is_build_config("path"), "L4").when(F.col("change").isin("added", "removed"), "L3").otherwise("L1")
    return changes.withColumn("impact", label)


def classify_source_change(changes: DataFrame, projects: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """VALID, STALE_RECOMMENDED or REINDEX_REQUIRED from the changed code files of each project."""
    t = {**fixed.FRESHNESS, **(thresholds or {})}
    agg = changes.where(is_code_file("path")).groupBy("project_id").agg(
        F.count("*").alias("changed_files"), F.count_if(is_high_risk_header("path")).alias("high_risk"))
    out = projects.select("project_id").distinct().join(agg, "project_id", "left").fillna(0, ["changed_files", "high_risk"])
    required = (F.col("changed_files") > t["source_large_files"]) | (F.col("high_risk") > t["header_impact_files"])
    state = F.when(F.col("changed_files") == 0, "VALID").when(required, "REINDEX_REQUIRED").otherwise("STALE_RECOMMENDED")
    return out.withColumn("state", state)


def evaluate_index_state(stored: DataFrame, current: DataFrame, moves: DataFrame, source: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Freshness of a snapshot; the first difference found decides: build boundary, scope, source.

    ``stored`` and ``current`` carry ``build_fp, scope_fp, source_fp, build_files`` (stored also ``files``);
    ``moves(project_id, moves)`` counts files whose class changed; ``source`` is ``classify_source_change``. A null
    stored fingerprint is not compared. A swap of equally many build files passes, as only the counts are compared.
    """
    t = {**fixed.FRESHNESS, **(thresholds or {})}
    cur = current.select("project_id", *[F.col(c).alias(f"c_{c}") for c in ("build_fp", "scope_fp", "source_fp", "build_files")])
    j = stored.join(cur, "project_id").join(moves, "project_id", "left").join(source.select("project_id", F.col("state").alias("source_state")), "project_id", "left")
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"c_{c}"), F.lit(False))
    delta = F.abs(F.coalesce("c_build_files", F.lit(0)) - F.coalesce("build_files", F.lit(0)))
    build_big = differs("build_fp") & F.col("c_build_fp").isNotNull() & (
        (delta > t["build_impact_files"]) | (delta / F.greatest(F.coalesce("build_files", F.lit(0)), F.lit(1)) > t["build_impact_ratio"]))
    moved = F.coalesce("moves", F.lit(0))
    ratio = moved / F.greatest(F.col("files"), F.lit(1))
    scope_big = (moved > t["scope_impact_files"]) | ((ratio > t["scope_impact_ratio"]) & (moved >= t["scope_impact_ratio_min_files"]))
    cause = F.when(build_big, "build").when(differs("scope_fp"), "scope").when(differs("source_fp"), "source").otherwise("none")
    state = (
        F.when(cause == "build", "REINDEX_REQUIRED").when((cause == "scope") & scope_big, "REINDEX_REQUIRED").when(cause == "scope", "STALE_RECOMMENDED")
        .when(cause == "source", F.coalesce("source_state", F.lit("VALID"))).otherwise("VALID")
    )
    return j.select("project_id", cause.alias("cause"), state.alias("state"), moved.alias("moves"), delta.alias("build_delta"))


def scope_moves(old_files: DataFrame, classified: DataFrame) -> DataFrame:
    """Files whose scope class differs from the stored one, per project; a file that is now ignored counts as moved,
    a file that only the new side has counts too."""
    a = old_files.select(*KEYS, F.col("scope_type").alias("_o"))
    b = classified.select(*KEYS, F.col("scope_type").alias("_n"))
    moved = F.when(F.col("_n").isNull(), F.col("_o").isNotNull()).otherwise(~F.col("_n").eqNullSafe(F.col("_o")))
    return a.join(b, KEYS, "full_outer").groupBy("project_id").agg(F.count_if(moved).alias("moves"))


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``target_path``: the file an include text names, by equality, else every file that ends in it.

    One file may end in the text of another; both directions of the suffix relation are equi-joins on exploded
    suffixes.
    """
    texts = includes.select("project_id", "target").distinct()
    tails = files.select("project_id", "path", F.explode(path_suffixes("path")).alias("target"))
    longer = texts.join(tails, ["project_id", "target"])
    own = texts.select("project_id", "target", F.explode(path_suffixes("target")).alias("path"))
    shorter = own.join(files.select("project_id", "path").distinct(), ["project_id", "path"])
    pairs = longer.select("project_id", "target", F.col("path").alias("target_path")).unionByName(
        shorter.select("project_id", "target", F.col("path").alias("target_path"))).distinct()
    return includes.join(pairs, ["project_id", "target"], "left")


def header_affected(headers: DataFrame, includes: DataFrame, files: DataFrame) -> DataFrame:
    """Every file that includes a changed header, directly or not (the header included), per start header.

    ``headers(project_id, path)``. The closure is complete; it stops only when nothing new is reached.
    """
    resolved = resolve_includes(includes, files).where("target_path is not null")
    edges = resolved.select("project_id", F.col("target_path").alias("src"), F.col("src").alias("dst")).distinct()
    starts = headers.select("project_id", F.col("path").alias("node"))
    return closure(starts, edges, ["project_id"]).withColumnRenamed("node", "path")


def patch_required(changes: DataFrame, includes: DataFrame, files: DataFrame, projects: DataFrame, limit: int | None = None) -> DataFrame:
    """REINDEX_REQUIRED when the changed headers of a project affect more files than the limit, else INCREMENTAL."""
    limit = fixed.FRESHNESS["header_impact_files"] if limit is None else limit
    headers = changes.where(is_code_file("path") & is_header("path"))
    hit = header_affected(headers, includes, files).groupBy("project_id").agg(F.count("*").alias("affected"))
    out = projects.select("project_id").distinct().join(hit, "project_id", "left").fillna(0, ["affected"])
    return out.withColumn("action", F.when(F.col("affected") > limit, "REINDEX_REQUIRED").otherwise("INCREMENTAL"))


def index_status(snapshots: DataFrame, current: DataFrame, schema_version: str = "2") -> DataFrame:
    """MISSING, CORRUPTED, VALID or STALE: ``snapshots(project_id, schema_version, fingerprint)`` against
    ``current(project_id, fingerprint)``."""
    s = snapshots.select("project_id", "schema_version", F.col("fingerprint").alias("_f"))
    state = (
        F.when(F.col("schema_version").isNull() & F.col("_f").isNull(), "MISSING")
        .when(F.coalesce("schema_version", F.lit("")) != schema_version, "CORRUPTED").when(F.col("_f") == F.col("fingerprint"), "VALID").otherwise("STALE")
    )
    return current.join(s, "project_id", "left").select("project_id", state.alias("status"))


def merge_symbols(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Old rows of unchanged files and new rows of changed files, one per (file, name, type), lowest ``ord`` first.

    ``changed(project_id, path)`` covers modified, added and removed files.
    """
    keys = changed.select("project_id", F.col("path").alias("file")).distinct()
    kept = old.join(keys, ["project_id", "file"], "left_anti")
    fresh = new.join(keys, ["project_id", "file"], "left_semi")
    cols = [c for c in old.columns if c not in ("project_id", "file", "name", "type")]
    rows = kept.unionByName(fresh.select(*old.columns))
    return rows.groupBy("project_id", "file", "name", "type").agg(F.min(F.struct("ord", *[c for c in cols if c != "ord"])).alias("r")).select(
        "project_id", "file", "name", "type", *[F.col(f"r.{c}").alias(c) for c in cols])


def patch_facts(old: DataFrame, new: DataFrame, changed: DataFrame, file_col: str = "file") -> DataFrame:
    """Facts of any kind: drop those of changed files, add the fresh ones of changed files."""
    keys = changed.select("project_id", F.col("path").alias(file_col)).distinct()
    return old.join(keys, ["project_id", file_col], "left_anti").unionByName(
        new.join(keys, ["project_id", file_col], "left_semi").select(*old.columns)).distinct()


def reuse_by_hash(old: DataFrame, fresh: DataFrame, keep: list[str]) -> DataFrame:
    """Fresh facts, with the old columns ``keep`` wherever (file, name) has the same file hash."""
    keys = ["project_id", "file", "name", "content_hash"]
    prior = old.groupBy(*keys).agg(F.max(F.struct(*keep)).alias("_o"))
    out = fresh.join(prior, keys, "left")
    same = F.col("_o").isNotNull()
    cols: list[Column] = [F.col(c) for c in fresh.columns if c not in keep]
    return out.select(*cols, *[F.when(same, F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c) for c in keep], same.alias("reused"))


def struct_usage(entries: DataFrame) -> DataFrame:
    """Distinct readers and writers of each field: ``entries(project_id, field, access, function)``."""
    fn = F.coalesce(F.nullif("function", F.lit("")), F.lit("(top-level)"))
    access = F.when(F.col("access") == "write", "write").otherwise("read")
    return entries.where(F.coalesce("field", F.lit("")) != "").select("project_id", "field", fn.alias("function"), access.alias("access")).distinct()


def file_universe(graph_files: DataFrame, disk_files: DataFrame) -> DataFrame:
    """All files of graph or disk; those the graph does not know are orphaned."""
    g = graph_files.select(*KEYS).distinct().withColumn("_g", F.lit(True))
    d = disk_files.select(*KEYS).distinct()
    return g.join(d, KEYS, "full_outer").select(*KEYS, F.when(F.col("_g"), "active").otherwise("orphaned").alias("status"))


def stale_documents(manifest: DataFrame, current: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents to refresh and why, per project.

    ``manifest(project_id, document, source_fp, build_fp, uses_build, modules, relations)`` (a null document row
    means it was never made), ``current(project_id, source_fp, build_fp)``, ``changed(project_id, kind, name)`` with
    kind module or relation.
    """
    cur = current.select("project_id", F.col("source_fp").alias("_s"), F.col("build_fp").alias("_b"))
    listed = manifest.select("project_id", "document", F.lit("module").alias("kind"), F.explode("modules").alias("name")).unionByName(
        manifest.select("project_id", "document", F.lit("relation").alias("kind"), F.explode("relations").alias("name")))
    touched = listed.join(changed.distinct(), ["project_id", "kind", "name"]).groupBy("project_id", "document").agg(
        F.bool_or(F.col("kind") == "module").alias("_m"), F.bool_or(F.col("kind") == "relation").alias("_r"))
    j = manifest.join(cur, "project_id", "left").join(touched, ["project_id", "document"], "left")
    reason = (
        F.when(F.col("source_fp").isNull() | F.col("_s").isNull() | (F.col("source_fp") != F.col("_s")), "source")
        .when(F.coalesce("_m", F.lit(False)), "module").when(F.coalesce("_r", F.lit(False)), "relation")
        .when(F.col("uses_build") & (F.col("build_fp") != F.col("_b")), "build")
    )
    return j.select("project_id", "document", reason.alias("reason")).where("reason is not null")


def changed_modules(changes: DataFrame, module_files: DataFrame) -> DataFrame:
    from codefacts.operators.lookups import module_of_file

    return module_of_file(changes.select(*KEYS), module_files).select("project_id", "module").distinct()
