"""Streams over the driver tables, run over all that is available: their rows equal those of the batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codefacts.catalog.base import add
from codefacts.catalog.sourceq import CP, c_sources
from codefacts.catalog.tasks import PAIRS, moves
from codefacts.functions import fixed
from codefacts.projection import Facts
from codefacts.session import cut_lineage, drop_lineage, scratch_folder
from codefacts.sources import store
from codefacts.streaming import maintain, ordered

#: How late events come here, in milliseconds of event time; batches of a stream, and rows of one of their files, about.
DELAY_MS = 6 * 3_600_000
BATCHES = 5
FILE_ROWS = 1_000_000
DAYS_MS = 86_400_000


def utc(ts: str = "ts") -> Column:
    """A time without a zone as an instant, whatever the zone of the session."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")))


def put_batch(rows: DataFrame, folder: str, number: int, files: int) -> None:
    """Writes ``rows`` as batch ``number`` of a stream over ``folder``: exactly ``files`` files, the last ones empty if need be."""
    spark, path = rows.sparkSession, f"{folder}/b{number:08d}"
    rows.coalesce(files).write.parquet(path)
    for _ in range(files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
        rows.limit(0).coalesce(1).write.mode("append").parquet(path)


def in_batches(spark: SparkSession, schema: StructType, folder: str, files: int) -> DataFrame:
    """The stream of the batches of ``put_batch``, in the order they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def paced(rows: DataFrame, delay_ms: int, quiet_ms: int, key: str) -> DataFrame:
    """A stream of ``rows`` (with ``seq`` and ``ts``) that arrive up to ``delay_ms`` of event time late, in shuffled batches.

    Each row is delayed by a hash of its ``seq``; a batch holds the rows of a span of arrival times. The last one ends with a
    clock row that moves the watermark past all rows and past ``quiet_ms`` of silence. A key costs about the same in every batch
    that meets it, so larger tables make larger batches of more files, not more batches.
    """
    spark = rows.sparkSession
    arrival = F.unix_millis("ts") + F.pmod(F.xxhash64("seq"), F.lit(delay_ms))
    dealt = cut_lineage(rows.withColumn("arrival", arrival))
    first, last, n, end = dealt.agg(F.min("arrival"), F.max("arrival"), F.count("*"), F.max(F.unix_millis("ts"))).first()
    if not n:
        first = last = end = 0
    width = (last - first) // BATCHES + 1
    files = max(1, -(-n // (BATCHES * FILE_ROWS)))
    folder = scratch_folder(spark)
    clock = spark.range(1).select(
        F.timestamp_millis(F.lit(end + delay_ms + quiet_ms + 60_000)).alias("ts"), F.lit(ordered.CLOCK).alias("type"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast(dict(rows.dtypes)[key]).alias(key))
    for k in range(BATCHES):  # one after the other, so that the stream meets them in this order
        part = dealt.where((F.col("arrival") >= first + k * width) & (F.col("arrival") < first + (k + 1) * width)).drop("arrival")
        part = part.unionByName(clock, allowMissingColumns=True) if k == BATCHES - 1 else part
        put_batch(part, folder, k, files)
    drop_lineage(dealt)
    return in_batches(spark, rows.schema, folder, files)


@add("t3_live_task_state", """
select m.task_id, max_by(to_s, seq) as state, count(*) filter (where from_s='REPAIRING' and to_s='EXECUTING') as iteration, max(seq) as last_seq from moves m
 left join (select task_id, min(seq) as e from moves where to_s='COMPLETED' group by task_id) x on x.task_id=m.task_id where x.e is null or m.seq<=x.e group by m.task_id""", PAIRS)
def t3(f: Facts) -> DataFrame:
    rows = moves(f).select("project_id", "task_id", "seq", utc().alias("ts"), "type", "from", "to")
    stream = paced(rows, DELAY_MS, 90 * DAYS_MS, "task_id")
    out, _ = ordered.drained(ordered.task_state(stream, f"{DELAY_MS} milliseconds", 60 * DAYS_MS))
    return out.groupBy("task_id").agg(F.max_by(F.struct("state", "iteration", "last_seq"), "last_seq").alias("s")).select("task_id", "s.*")


@add("t4_live_tool_pairs", "select task_id, start_seq, end_seq from pairs", PAIRS)
def t4(f: Facts) -> DataFrame:
    rows = f.events.select("project_id", "task_id", "seq", utc().alias("ts"), "type")
    stream = paced(rows, DELAY_MS, 90 * DAYS_MS, "task_id")
    out, _ = ordered.drained(ordered.tool_pairs(stream, f"{DELAY_MS} milliseconds", 60 * DAYS_MS))
    return out.select("task_id", "start_seq", "end_seq")


def stage_events(f: Facts) -> DataFrame:
    """The events as stages of one run per user, in a time that runs 240 times as fast."""
    at = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    ts = F.timestamp_millis(F.floor(F.unix_micros(utc()) / 240_000))
    return f.table("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), ts.alias("ts"), F.lit("Stage").alias("type"),
        at(fixed.STAGES, F.floor("value") % len(fixed.STAGES)).alias("stage"), at(fixed.STATUSES, F.col("event_id") % len(fixed.STATUSES)).alias("status"))


IDLE_MS = 300_000


@add("t2_stage_beats", f"""
select run_id, 'heartbeat' as kind, unnest(range(since + 15000, until, 15000)) as at, stage from (
 select run_id, any_value(stage) filter (where status='running') as stage, min(ms) as since,
  least(coalesce(any_value(following) filter (where status='running'), 9223372036854775807), coalesce(min(ms) filter (where status in ('completed','failed') and stage=running), 9223372036854775807),
   any_value(quiet) filter (where status='running')) as until from grouped where g > 0 group by run_id, g)
union all select run_id, 'stage', ms, stage from st""", {
    "st": f"""select user_id as run_id, event_id as seq, epoch_us(ts) // 240000 as ms, {fixed.STAGES}[cast(floor(value) as bigint) % {len(fixed.STAGES)} + 1] as stage,
      {fixed.STATUSES}[event_id % {len(fixed.STATUSES)} + 1] as status from events""",
    "spells": f"select *, sum(case when gap > {IDLE_MS} then 1 else 0 end) over (partition by run_id order by seq) as spell from (select *, ms - lag(ms) over (partition by run_id order by seq) as gap from st)",
    "quieted": f"select *, max(ms) over (partition by run_id, spell) + {IDLE_MS} + 1 as quiet, sum(case when status='running' then 1 else 0 end) over (partition by run_id order by seq) as g from spells",
    "grouped": """select *, max(case when status='running' then stage end) over (partition by run_id, g) as running, nexts.following from quieted left join
      (select run_id as r, g as h, lead(ms) over (partition by run_id order by seq) as following from quieted where status='running') nexts on nexts.r=run_id and nexts.h=g"""})
def t2(f: Facts) -> DataFrame:
    stream = paced(stage_events(f), 60_000, 3_600_000, "run_id")
    out, _ = ordered.drained(ordered.stage_beats(stream, "60000 milliseconds", IDLE_MS))
    return out.select("run_id", "kind", "at", "stage")


def change_feed(f: Facts) -> list[DataFrame]:
    """Batches of changes of the C sources: all files, then edits and deletions, then late copies of the first versions."""
    size = F.regexp_extract("text", r"#define MAX_\d+ (\d+)", 1).cast("int")
    first = c_sources(f).withColumn("size", size)
    row = lambda df, op, text, seq: df.select("project_id", "path", F.lit(op).alias("op"), text.alias("text"), F.lit(seq).cast("bigint").alias("seq"))
    edited = F.regexp_replace("text", r"(#define MAX_\d+) \d+", "$1 1")
    half = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    added = [row(first.where(c), "upsert", F.col("text"), 1) for c in (half, ~half)]
    edits = row(first.where("size > 25 and size <> 50"), "upsert", edited, 3).unionByName(row(first.where("size = 50"), "delete", F.lit(None).cast("string"), 4))
    return [*added, edits, row(first.where("size > 40"), "upsert", F.col("text"), 2)]


@add("t5_maintained_facts", """
select 'firmware' as project_id, path, concat('MAX_',p_partkey) as name, case when p_size > 25 then '1' else cast(p_size as varchar) end as value, 15 as end_line from cp where p_size <> 50
union all select 'library', path, concat('MAX_',p_partkey), cast(p_size as varchar), 15 from cp where p_size < 10""", CP)
def t5(f: Facts) -> DataFrame:
    """One stream brings the changes of a project, a second one with its own batches a new project."""
    spark = f.spark
    root = scratch_folder(spark)
    files = max(1, -(-f.table("part").count() // FILE_ROWS))
    feeds = [change_feed(f), [change_feed(f)[0].unionByName(change_feed(f)[1]).where(F.regexp_extract("text", r"#define MAX_\d+ (\d+)", 1).cast("int") < 10).withColumn("project_id", F.lit("library"))]]
    for feed in feeds:
        folder = scratch_folder(spark)
        for k, batch in enumerate(feed):
            put_batch(batch, folder, k, files)
        stream = in_batches(spark, feed[0].schema, folder, files)
        maintain.maintain_facts(stream, root, scratch_folder(spark), shards=8).awaitTermination()
    tables = store.read_index(spark, root)[1]
    ends = tables["functions"].select("project_id", "path", "end_line")
    return tables["macros"].select("project_id", "path", "name", "value").join(ends, ["project_id", "path"])
