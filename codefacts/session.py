"""Session settings used by the tests, the benchmark and stand-alone runs."""

from __future__ import annotations

import atexit
import os
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "codefacts", cpus: str | int = "*", shuffle: int | None = None) -> SparkSession:
    """A local session; on a cluster the caller passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CODEFACTS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle or 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Broadcasts by the size of a table's files, and by the rows counted in a shuffle; each costs the driver its rows and a page of memory.
GUESSED_BYTES, COUNTED_BYTES = 16 * 1024, 1024 * 1024


def measured_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which joins broadcast only small sides, by their measured size.

    The planner takes the size of a table from its compressed files, with the columns and lists that a query derives
    left out, so a few MB of Parquet become hundreds of MB on the driver. Here a join shuffles first, and is turned into a
    broadcast when the shuffled side is known to be small. Lower thresholds of ``spark`` are kept.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    limit = own._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    counted = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    if counted is None and limit > COUNTED_BYTES:
        own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(COUNTED_BYTES))
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", str(min(limit, GUESSED_BYTES)))
    return own


#: Shuffled bytes a task should read, and bytes of input files behind one shuffle partition, where tasks hold wide rows in memory.
FINE_BYTES, FINE_INPUT = 8 * 1024 * 1024, 2 * 1024 * 1024


def _bytes(size: str | None) -> int:
    """A size as Spark's settings write it (``64MB``, ``8m``, ``1024b``, plain bytes), 0 where none is given."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", (size or "").lower())
    return int(m.group(1)) * 1024 ** " kmgtp".index(m.group(2) or " ") if m else 0


def fine_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Makes the shuffle partitions of this session as many as the input asks for, and small ones.

    A fixed number of partitions lets the memory of a task grow with the tables; text that compresses well fills many times its
    shuffled size there. Small neighbours are still merged, settings of the caller that ask for more or smaller ones are kept.
    """
    conf = spark._jsparkSession.sessionState().conf()
    parts = max(conf.numShufflePartitions(), -(-input_bytes // FINE_INPUT), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, str(min(_bytes(spark.conf.get(key, None)) or FINE_BYTES, FINE_BYTES)))


_WRITTEN: set[str] = set()


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else one below the session's warehouse, which all executors share."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    home = spark.conf.get("spark.sql.warehouse.dir")
    if not named and not sc.master.startswith("local") and home.startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lineage").rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; it is deleted when the program ends."""
    if not _WRITTEN:
        atexit.register(_drop_all, spark)
    path = f"{_shared_folder(spark)}/codefacts-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Later plans start at the files: nothing before is computed again, a lost executor costs only the tasks that ran
    on it, and the known file size lets the optimizer choose the join strategy. The files go when the program ends, or
    earlier by ``drop_lineage``.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lineage_path = path
    return out


def cut_lineages(*frames: DataFrame) -> list[DataFrame]:
    """``cut_lineage`` of several frames that do not build on each other; their jobs run side by side."""
    with ThreadPoolExecutor(max(1, len(frames))) as pool:
        return list(pool.map(cut_lineage, frames))


def drop_lineage(df: DataFrame) -> None:
    """Delete the files behind a DataFrame of ``cut_lineage`` that nothing reads any more."""
    path = getattr(df, "_lineage_path", None)
    if path in _WRITTEN:
        delete_folder(df.sparkSession, path)
        _WRITTEN.discard(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all(spark: SparkSession) -> None:
    try:
        for path in _WRITTEN:
            delete_folder(spark, path)
    except Exception:  # noqa: BLE001 - the session has ended; its folder is the cluster's to clear
        pass
