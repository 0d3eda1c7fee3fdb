"""Symbols and edges from code-graph nodes and edges, and merges with parsed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions.paths import stem_of
from codefacts.functions.records import confidence_level, edge_confidence
from codefacts.operators.scope import classify_scope


def symbols_from_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Code entities outside ignored files: file and import nodes are left out."""
    rows = nodes.where(~F.col("kind").isin("file", "import")).select(
        "project_id", "name", "qualified_name", F.col("kind").alias("type"), F.col("file_path").alias("path"),
        "start_line", "end_line", F.col("signature").alias("signature_raw"),
    )
    return classify_scope(rows, rules).withColumnRenamed("path", "file")


def _ends(nodes: DataFrame, rules: DataFrame, prefix: str) -> DataFrame:
    rows = nodes.select("project_id", "id", "kind", "name", F.col("file_path").alias("path"))
    scoped = classify_scope(rows, rules)
    return scoped.select("project_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "kind", "name", "path", "scope_type")])


def call_edges(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Call edges whose ends are both kept; library-internal ones are dropped, border ones marked external."""
    rows = edges.where(F.col("kind") == "calls").select(
        "project_id", F.col("source").alias("src_id"), F.col("target").alias("dst_id"),
        edge_confidence("metadata").alias("confidence_score"), "line",
    )
    joined = rows.join(_ends(nodes, rules, "src"), ["project_id", "src_id"]).join(_ends(nodes, rules, "dst"), ["project_id", "dst_id"])
    lib = [F.col(f"{p}_scope_type") == "third_party" for p in ("src", "dst")]
    return joined.where(~(lib[0] & lib[1])).select(
        "project_id", F.col("src_name").alias("caller"), F.col("dst_name").alias("callee"),
        confidence_level("confidence_score").alias("confidence"), "confidence_score", F.col("src_path").alias("file"), "line",
        (lib[0] | lib[1]).alias("external"),
    )


def include_edges(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct import edges between file nodes that are both kept."""
    rows = edges.where(F.col("kind") == "imports").select(
        "project_id", F.col("source").alias("src_id"), F.col("target").alias("dst_id")
    )
    files = nodes.where(F.col("kind") == "file")
    return (
        rows.join(_ends(files, rules, "src"), ["project_id", "src_id"]).join(_ends(files, rules, "dst"), ["project_id", "dst_id"])
        .select("project_id", F.col("src_path").alias("src"), F.col("dst_path").alias("target")).distinct()
    )


MERGED = ["signature", "members", "value", "value_expr"]
KEY = ["project_id", "file", "name", "type"]


def merge_semantics(symbols: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed facts fill empty fields of graph symbols; parsed symbols the graph lacks are appended once.

    Both sides carry ``ord``. Of several graph symbols with one key the last is the target; of several parsed
    symbols the first fills the fields.
    """
    first = parsed.groupBy(*KEY).agg(
        F.min_by(F.struct(*MERGED, "start_line", "end_line"), "ord").alias("p"), F.min("ord").alias("_po")
    )
    last = symbols.groupBy(*KEY).agg(F.max("ord").alias("ord")).withColumn("_target", F.lit(True))
    marked = symbols.join(last, [*KEY, "ord"], "left")
    both = marked.join(first, KEY, "full_outer")
    is_target = F.coalesce("_target", F.lit(False))

    def filled(name: str):
        own = F.col(name) if name in symbols.columns else F.lit(None).cast(parsed.schema[name].dataType)
        empty = own.isNull()
        if dict(parsed.dtypes)[name] == "string":
            empty = empty | (own == "")
        return F.when(is_target & empty, F.col(f"p.{name}")).otherwise(own)

    new = F.col("ord").isNull()
    return both.select(
        *KEY, F.coalesce("ord", "_po").alias("ord"), new.alias("appended"),
        F.when(new, F.col("p.start_line")).otherwise(F.col("start_line")).alias("start_line"),
        F.when(new, F.col("p.end_line")).otherwise(F.col("end_line")).alias("end_line"),
        *[F.when(new, F.col(f"p.{n}")).otherwise(filled(n)).alias(n) for n in MERGED],
        (new | (is_target & F.col("p").isNotNull())).alias("semantic"),
    )


def filter_indirect_calls(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bindings whose name is a function; one row per (name, via, file, line)."""
    fns = symbols.where(F.col("type") == "function").select("project_id", "name").distinct()
    kept = bindings.join(fns, ["project_id", "name"], "left_semi")
    keys = ["project_id", F.col("name").alias("callee"), "via", "file", "line"]
    first = F.min(F.struct("caller_hint", "field"))
    return kept.groupBy(*keys).agg(first.alias("f")).select(
        "project_id", "callee", "via", "file", "line", F.col("f.caller_hint").alias("caller_hint"),
        F.lit("high").alias("confidence"), F.col("f.field").alias("field"),
    )


def registered_callbacks(fields: DataFrame, indirect: DataFrame) -> DataFrame:
    """Functions bound to a struct field: same field name, same file stem, in long form.

    ``fields(project_id, struct, field, file)``. Both sides are distinct before they meet, and the stem follows from the
    file, so the pairs are distinct without a shuffle.
    """
    bound = indirect.where(F.col("via") == "field_assign").select(
        "project_id", "field", stem_of("file").alias("_stem"), F.col("callee").alias("registered")
    ).distinct()
    return (
        fields.select("project_id", "struct", "field", "file").distinct().withColumn("_stem", stem_of("file"))
        .join(bound, ["project_id", "field", "_stem"]).select("project_id", "struct", "field", "file", "registered")
    )


def annotate_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """scope_type and scope_name of the symbol's file; project when the file is unknown."""
    known = files.select("project_id", F.col("path").alias("file"), "scope_type", "scope_name")
    out = symbols.drop("scope_type", "scope_name").join(known, ["project_id", "file"], "left")
    return out.withColumn("scope_type", F.coalesce("scope_type", F.lit("project")))


def drop_changed_facts(facts: DataFrame, changed: DataFrame, file_col: str = "file") -> DataFrame:
    """Facts of files that did not change; ``changed(project_id, path)``."""
    keys = changed.select("project_id", F.col("path").alias(file_col)).distinct()
    return facts.join(keys, ["project_id", file_col], "left_anti")
