"""Content hashes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import fixed
from codefacts.functions.paths import base_name, is_build_config, is_code_file
from codefacts.operators.scope import classify_scope


def content_hash(content: Column | str, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.col(content) if isinstance(content, str) else content, 256), 1, digits)


def file_hashes(files: DataFrame, content: str = "text") -> DataFrame:
    return files.select("project_id", "path", content_hash(content).alias("content_hash"))


def config_hashes(files: DataFrame, content: str = "text") -> DataFrame:
    """Hashes of the top-level build configuration files only."""
    top = ~F.contains("path", F.lit("/"))
    wanted = is_build_config("path") | base_name("path").isin(fixed.CONFIG_NAMES)
    return files.where(top & wanted).select("project_id", F.col("path").alias("name"), content_hash(content).alias("content_hash"))


def fingerprint(files: DataFrame, content: str = "text") -> DataFrame:
    """Complete two-level hash of paths and contents, eight digits, with its ``algorithm``: every file of a project counts."""
    return tree_fingerprint(files, "path", F.sha2(F.col(content), 256))


def project_fingerprint(files: DataFrame, rules: DataFrame, content: str = "text") -> DataFrame:
    """Fingerprint of the files the scope rules keep."""
    return fingerprint(classify_scope(files, rules), content)


def source_fingerprint(files: DataFrame, content: str = "text") -> DataFrame:
    """Fingerprint of code files only, whatever the scope rules say."""
    return fingerprint(files.where(is_code_file("path")), content)


def tree_fingerprint(items: DataFrame, key: str = "path", value: Column | None = None) -> DataFrame:
    """Two-level hash of all rows of a project: hash buckets by the key's SHA-256 first, then the bucket hashes.

    The one algorithm for projects of any size; a bucket holds 1/4096 of a project.
    """
    row = F.sha2(F.concat_ws("|", F.col(key), value if value is not None else F.lit("")), 256)
    buckets = items.select("project_id", F.substring(F.sha2(F.col(key), 256), 1, 3).alias("_b"), row.alias("_h"))
    inner = buckets.groupBy("project_id", "_b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), ""), 256).alias("_h"))
    outer = inner.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("_b", "_h"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["_b"], x["_h"])), ",")
    return outer.select("project_id", F.substring(F.sha2(text, 256), 1, 8).alias("fingerprint"), F.lit("tree").alias("algorithm"))


def _json_text(value: Column) -> Column:
    """JSON string literal of a text."""
    inner = F.to_json(F.array(value))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), _json_text), ", "), F.lit("]"))


def scope_fingerprint(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Hash of the canonical JSON of the five scope settings.

    ``rules`` as in the scope operators (one configuration file per project, so the lists are bounded);
    ``targets(project_id, build_target)``.
    """
    def of(kind: str, value: Column | str = "pattern") -> Column:
        return _json_list(F.collect_list(F.when(F.col("kind") == kind, F.col(value) if isinstance(value, str) else value)))

    pair = F.concat_ws("|", "pattern", F.coalesce("name", F.lit("")))
    rows = rules.groupBy("project_id").agg(
        of("ignore").alias("i"), of("project").alias("p"), of("third_party", pair).alias("t"), F.bool_or(F.col("kind") == "project").alias("s"),
    ).join(targets, "project_id", "left")
    blob = F.concat(
        F.lit('{"build_target": '), F.coalesce(_json_text(F.col("build_target")), F.lit("null")), F.lit(', "ignore": '), "i",
        F.lit(', "project_include": '), "p", F.lit(', "project_include_set": '), F.col("s").cast("string"), F.lit(', "third_party": '), "t", F.lit("}"),
    )
    return rows.select("project_id", F.substring(F.sha2(blob, 256), 1, 8).alias("fingerprint"))


def build_fingerprint(build_files: DataFrame, builds: DataFrame) -> DataFrame:
    """Two-level hash of target, compiled and excluded files; null for an unresolved build, the target alone without files."""
    rows = build_files.select("project_id", "path", "compiled").distinct()
    tree = tree_fingerprint(rows, "path", F.col("compiled").cast("string")).select("project_id", F.col("fingerprint").alias("tree"))
    value = F.substring(F.sha2(F.concat_ws("|", "target", "tree"), 256), 1, 8)
    return builds.join(tree, "project_id", "left").select("project_id", F.when(F.col("resolved"), value).alias("fingerprint"), F.lit("tree").alias("algorithm"))
