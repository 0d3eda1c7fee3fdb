"""Snapshots, state tables, reports and documents as Parquet, JSON and text.

A snapshot is a set of immutable table folders; its manifest row is written last, so a snapshot without a manifest
row does not exist and a failed write changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from codefacts.session import cut_lineage, delete_folder, drop_lineage

SCHEMA_VERSION = "2"
INDEX_VERSION = "1.6"
MANIFEST = "number bigint, snapshot_id string, stream string, batch_id bigint, schema_version string, index_version string, tables map<string,string>, schemas map<string,string>, generated_at timestamp"
STATE_TABLES = {
    "tasks": "project_id string, task_id string, goal string, state string, iteration int, max_iterations int, created_at timestamp, updated_at timestamp",
    "agents": "project_id string, task_id string, agent_id string, role string, status string, updated_at timestamp",
    "messages": "project_id string, task_id string, id string, sender string, receiver string, type string, content string, created_at timestamp",
    "changes": "project_id string, task_id string, id string, file string, operation string, timestamp timestamp",
    "findings": "project_id string, task_id string, id string, severity string, description string, location string, status string, created_at timestamp",
    "evidence": "project_id string, task_id string, id string, type string, command string, exit_code int, result string, timestamp timestamp",
    "decisions": "project_id string, task_id string, id string, result string, rule string, reason string, created_at timestamp",
    "events": "project_id string, task_id string, seq bigint, type string, agent_id string, payload string, ts timestamp",
    "projects": "project_id string, name string, root string, created_at timestamp",
}
#: What identifies a row of the tables whose rows change; a change is a newer revision of the row.
STATE_KEYS = {"projects": ["project_id"], "tasks": ["project_id", "task_id"], "agents": ["project_id", "task_id", "agent_id"], "findings": ["project_id", "id"]}


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one with the schema when it cannot be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/manifest", MANIFEST)


def _last(spark: SparkSession, root: str) -> Row | None:
    """Manifest row of the newest snapshot; they are numbered, as clocks of writers differ."""
    return _manifest(spark, root).orderBy(F.desc_nulls_last("number"), F.desc("generated_at")).first()


def committed(spark: SparkSession, root: str, stream: str, batch_id: int) -> bool:
    """Whether a batch of a stream is in a snapshot; batches of different streams never stand for each other."""
    return not _manifest(spark, root).where((F.col("batch_id") == batch_id) & (F.coalesce("stream", F.lit("")) == stream)).isEmpty()


def next_number(spark: SparkSession, root: str) -> int:
    last = _last(spark, root)
    return (last["number"] or 0) + 1 if last else 1


def commit(spark: SparkSession, root: str, snapshot_id: str, folders: dict[str, str], schemas: dict[str, str], stream: str = "", batch_id: int = -1) -> None:
    """One manifest row in one file, which is what makes a snapshot exist."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]).cast("map<string,string>")
    row = spark.range(1).select(
        F.lit(next_number(spark, root)).cast("bigint").alias("number"), F.lit(snapshot_id).alias("snapshot_id"), F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(INDEX_VERSION).alias("index_version"), pairs(folders).alias("tables"), pairs(schemas).alias("schemas"), F.current_timestamp().alias("generated_at"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def write_index(tables: dict[str, DataFrame], root: str, snapshot_id: str, batch_id: int = -1, reuse: dict[str, tuple[str, str]] | None = None, stream: str = "") -> bool:
    """Write one snapshot; ``reuse`` names (folder, schema) of tables of an older snapshot that stay as they are.

    A batch of ``stream`` that was committed before is skipped, so a replayed stream batch writes nothing twice.
    """
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    if batch_id >= 0 and committed(spark, root, stream, batch_id):
        return False
    folders = {k: v[0] for k, v in (reuse or {}).items()}
    schemas = {k: v[1] for k, v in (reuse or {}).items()}
    for name, df in tables.items():
        folders[name] = f"{root}/{snapshot_id}/{name}"
        schemas[name] = df.schema.json()
        writer = df.write.mode("overwrite")
        (writer.partitionBy("project_id") if "project_id" in df.columns else writer).parquet(folders[name])
    commit(spark, root, snapshot_id, folders, schemas, stream, batch_id)
    return True


def read_index(spark: SparkSession, root: str) -> tuple[str, dict[str, DataFrame]]:
    """(VALID, MISSING or CORRUPTED; tables) of the latest snapshot."""
    last = _last(spark, root)
    if not last:
        return "MISSING", {}
    if last["schema_version"] != SCHEMA_VERSION:
        return "CORRUPTED", {}
    try:
        # the stored schema also serves tables that are empty
        schemas = {k: T.StructType.fromJson(json.loads(v)) for k, v in last["schemas"].items()}
        return "VALID", {name: spark.read.schema(schemas[name]).parquet(path) for name, path in last["tables"].items()}
    except AnalysisException:
        return "CORRUPTED", {}


def replace_shards(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Puts ``rows`` (with ``shard``) in place of the touched shards of a table; the files of other shards stay.

    The rows are staged first, as they are made from the shards they replace. A shard without rows goes. Doing it again
    with the same rows changes nothing.
    """
    staged = cut_lineage(rows)
    # a large shard is written by several tasks
    staged.hint("rebalance", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    held = {r["shard"] for r in staged.select("shard").distinct().collect()}  # at most the shards
    for shard in set(touched) - held:
        delete_folder(rows.sparkSession, f"{path}/shard={shard}")
    drop_lineage(staged)


def refresh_index(spark: SparkSession, root: str, snapshot_id: str, files: DataFrame) -> bool:
    """New snapshot with fresh file hashes only; all other tables keep their folders."""
    last = _last(spark, root)
    reuse = {k: (v, last["schemas"][k]) for k, v in last["tables"].items() if k != "files"} if last else {}
    return write_index({"files": files}, root, snapshot_id, reuse=reuse)


def _columns(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in STATE_TABLES[table].split(",")]


def append_state(rows: DataFrame, root: str, table: str) -> None:
    """Insert rows into one of the nine state tables."""
    own = rows.select(*_columns(table), (F.col("revision") if "revision" in rows.columns else F.lit(0)).cast("bigint").alias("revision"))
    own.write.mode("append").partitionBy("project_id").parquet(f"{root}/{table}")


def _newest(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of a table, of those that change the last revision, with its number."""
    df = read_or_empty(spark, f"{root}/{table}", STATE_TABLES[table] + ", revision bigint").withColumn("revision", F.coalesce("revision", F.lit(0)))
    if table not in STATE_KEYS:
        return df
    rest = [c for c in df.columns if c not in STATE_KEYS[table]]
    return df.groupBy(*STATE_KEYS[table]).agg(F.max(F.struct("revision", *[c for c in rest if c != "revision"])).alias("r")).select(
        *STATE_KEYS[table], *[F.col(f"r.{c}").alias(c) for c in rest])


def update_state(changes: DataFrame, root: str, table: str) -> None:
    """Sets the columns of ``changes`` in the rows that its keys name, where they exist; a null changes nothing.

    The old row stays, a newer revision stands before it; so nothing is rewritten and a reader sees the old or the new row.
    """
    keys = STATE_KEYS[table]
    given = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in given])
    rows = _newest(changes.sparkSession, root, table).join(new, keys)
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in given}).withColumn("revision", F.col("revision") + 1)
    append_state(cut_lineage(rows), root, table)


def get_state(spark: SparkSession, root: str, table: str, ids: DataFrame) -> DataFrame:
    """Rows of a state table that ``ids`` names by some of its columns; what does not exist has no row."""
    return _newest(spark, root, table).drop("revision").join(ids.distinct(), ids.columns, "left_semi")


def list_state(spark: SparkSession, root: str, table: str, task_id: str | None = None, after_seq: int | None = None) -> DataFrame:
    """Rows of a state table, by task, in time order; events by ``seq`` after a position."""
    df = _newest(spark, root, table).drop("revision").select(*_columns(table))
    if task_id is not None:
        df = df.where(F.col("task_id") == task_id)
    if after_seq is not None:
        df = df.where(F.col("seq") > after_seq)
    order = "seq" if table == "events" else next(c for c in ("created_at", "timestamp", "updated_at") if c in df.columns)
    return df.orderBy(order)


DOCUMENTS = ("project_id string, document string, modules array<string>, relations array<string>, knowledge_sources array<string>, uses_build boolean, "
             "source_fp string, build_fp string, scope_fp string")


def load_document_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What was recorded of the documents of each project; nothing where there is no manifest or it cannot be read."""
    return read_or_empty(spark, path, DOCUMENTS)


def record_documents(made: DataFrame, current: DataFrame, path: str) -> None:
    """Records documents that were made, in place of what was known of them, and the fingerprints that they rest on.

    ``made(project_id, document, modules, relations, knowledge_sources, uses_build)``; ``current(project_id, source_fp,
    build_fp, scope_fp)`` becomes the baseline of all documents of its projects. Other projects are not touched.
    """
    spark = made.sparkSession
    keys = ["project_id", "document"]
    lists = ["modules", "relations", "knowledge_sources"]
    new = made.select(*keys, *[F.array_sort(F.array_distinct(c)).alias(c) for c in lists], "uses_build")
    old = load_document_manifest(spark, path).select(*keys, *lists, "uses_build").join(current.select("project_id"), "project_id", "left_semi").join(new.select(*keys), keys, "left_anti")
    rows = cut_lineage(old.unionByName(new).join(current.select("project_id", "source_fp", "build_fp", "scope_fp"), "project_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def documents_present(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Whether the file of each recorded document is there: ``files(project_id, path)``."""
    there = files.select("project_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("document")).distinct().withColumn("_t", F.lit(True))
    return manifest.join(there, ["project_id", "document"], "left").select("project_id", "document", F.col("_t").isNotNull().alias("present"))


RESPONSIBILITY = "project_id string, module string, responsibility string, confidence string, generated_by string, entry_points string, dependencies string, consumers string, symbol_count bigint"


def save_responsibilities(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def load_responsibilities(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, RESPONSIBILITY)


def change_report(changes: DataFrame) -> DataFrame:
    """Report lines per project and section in long form: ``changes(project_id, path, change, impact)``."""
    tag = F.when(F.col("change") == "removed", F.lit("")).otherwise(F.concat(F.lit(" (Impact: "), "impact", F.lit(")")))
    return changes.select("project_id", F.col("change").alias("section"), "path", F.concat(F.lit("- "), "path", tag).alias("line"))


def write_change_report(changes: DataFrame, folder: str) -> None:
    """The report as JSON rows and as Markdown lines, sorted inside each section by the writer tasks."""
    changes.write.mode("overwrite").json(f"{folder}/json")
    lines = change_report(changes).repartitionByRange("project_id", "section", "path").sortWithinPartitions("project_id", "section", "path")
    lines.select(F.concat_ws("\t", "project_id", "section", "line").alias("value")).write.mode("overwrite").text(f"{folder}/markdown")
