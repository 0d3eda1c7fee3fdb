"""Fact tables kept up to date from a stream of changed and deleted files."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from codefacts.functions import fixed
from codefacts.operators import extract
from codefacts.plans import refresh
from codefacts.session import cut_lineage, drop_lineage
from codefacts.sources import store

FILE = ["project_id", "path"]
TABLES = [*refresh.FACTS, "errors", "files"]
#: Parts of every fact table, by a hash of project and path; a change rewrites the parts of its files only.
SHARDS = 64
APPLIED = "project_id string, path string, seq bigint, deleted boolean, shard int"


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64(*FILE), F.lit(shards)).cast("int")


def newest(batch: DataFrame, number: int) -> DataFrame:
    """The last change of each file in a batch: ``project_id, path, op, text, seq``.

    Without ``op`` every row is an upsert. ``seq`` orders the changes of a file, also across batches and streams; without it
    the batch is newer than all before, and two texts for one file in it are an error. A change without project or path
    names no file and is left out.
    """
    rows = batch.where("project_id is not null and path is not null")
    rows = rows if "op" in rows.columns else rows.withColumn("op", F.lit("upsert"))
    if "seq" in rows.columns:
        best = F.max_by(F.struct("op", "text"), F.struct("seq", "op", "text")).alias("c")
        return rows.groupBy(*FILE).agg(best, F.max("seq").alias("seq")).select(*FILE, "c.op", "c.text", F.coalesce("seq", F.lit(0)).alias("seq"))
    one = F.count_distinct(F.struct("op", "text")) == 1
    error = F.raise_error(F.concat(F.lit("several changes without seq for "), F.col("path")))
    first = F.min(F.struct("op", "text")).alias("c")
    return rows.groupBy(*FILE).agg(first, one.alias("one")).select(*FILE, F.when(F.col("one"), F.col("c.op")).otherwise(error).alias("op"), "c.text", F.lit(number).cast("bigint").alias("seq"))


def apply_changes(batch: DataFrame, root: str, stream: str, batch_id: int, large_change: int | None = None, shards: int = SHARDS) -> bool:
    """Applies one batch to the facts under ``root``; false where it is in a snapshot already.

    Changes older than what a file has seen are ignored, and a deleted file stays deleted until a newer upsert. Of every
    fact table only the shards of changed files are read and written. The table of applied changes is written last and the
    snapshot is committed after it, so a batch that broke off is simply applied again. A project with more changed files
    than ``large_change`` is also listed in ``set_aside`` as REINDEX_REQUIRED: a full refresh is advised, nothing is lost
    without it. One writer at a time.
    """
    spark = batch.sparkSession
    limit = fixed.FRESHNESS["source_large_files"] if large_change is None else large_change
    if store.committed(spark, root, stream, batch_id):
        return False
    number = store.next_number(spark, root)
    rows = cut_lineage(newest(batch, number).withColumn("shard", shard_of(shards)))
    applied = store.read_or_empty(spark, f"{root}/facts/applied", APPLIED)
    old = applied.select(*FILE, "shard", F.col("seq").alias("seen"))
    news = cut_lineage(rows.join(old, [*FILE, "shard"], "left").where("seen is null or seq > seen"))
    touched = sorted(r["shard"] for r in news.select("shard").distinct().collect())  # at most the shards
    known = applied.where("not deleted").select("project_id").distinct()
    counts = news.groupBy("project_id").agg(F.count("*").alias("n"))
    aside = counts.where(F.col("n") > limit).join(known, "project_id", "left_semi").select("project_id", "n", F.lit("REINDEX_REQUIRED").alias("state"))
    folders = {name: f"{root}/facts/{name}" for name in TABLES} | {"set_aside": f"{root}/set_aside/{number:08d}"}
    schemas = {"set_aside": aside.schema.json()}
    aside.coalesce(1).write.mode("overwrite").parquet(folders["set_aside"])
    changed = news.where("op <> 'delete'").select(*FILE, "text")
    # parsing costs far more than its few bytes suggest: the files are dealt to all cores, and parsed once for all tables
    good = extract.size_guard(changed)[0].repartition(spark.sparkContext.defaultParallelism, *FILE)
    seen = cut_lineage(extract.bracket_facts(good))
    fresh = refresh.extract_facts(changed, seen=seen)

    def replace(name: str) -> None:
        new = fresh[name].withColumn("shard", shard_of(shards))
        schemas[name] = fresh[name].schema.json()
        kept = store.read_or_empty(spark, folders[name], _ddl(new)).where(F.col("shard").isin(touched)).join(news.select(*FILE), FILE, "left_anti")
        store.replace_shards(kept.select(*new.columns).unionByName(new), folders[name], touched)

    with ThreadPoolExecutor(len(TABLES)) as pool:  # the tables are independent; Spark runs their jobs side by side
        list(pool.map(replace, TABLES))
    state = news.select(*FILE, "seq", (F.col("op") == "delete").alias("deleted"), "shard")
    kept = applied.where(F.col("shard").isin(touched)).join(news.select(*FILE), FILE, "left_anti")
    store.replace_shards(kept.select(*state.columns).unionByName(state), f"{root}/facts/applied", touched)
    store.commit(spark, root, f"{stream}-{batch_id}", folders, schemas, stream, batch_id)
    for df in (rows, news, seen):
        drop_lineage(df)
    return True


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def maintain_facts(files: DataFrame, root: str, checkpoint: str, large_change: int | None = None, shards: int = SHARDS) -> StreamingQuery:
    """Keeps the facts under ``root`` up to date from a stream ``(project_id, path, text[, op][, seq])``; ``op`` is upsert or delete.

    Batches are known by the id of the query, which the checkpoint holds, and their number: a replayed batch is skipped, and
    a second stream into the same facts is none of the first. See ``newest`` and ``apply_changes``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        meta = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()
        apply_changes(batch, root, json.loads(meta["value"])["id"], batch_id, large_change, shards)

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
