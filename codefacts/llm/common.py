"""Helpers shared by the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.session import cut_lineage, drop_lineage

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text, counted without keeping them: every word becomes one character, white space goes."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), r"[^w]+", "")).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` → ``node``, ``component`` (the smallest node reachable).

    Smallest labels spread over the edges and then jump to the label of their label, so a chain of length n takes about
    log n rounds. Minima combine before the shuffle, a node with very many edges costs no single task; each round is
    written to the shared folder. Only nodes with an edge are returned; null ends are ignored; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s is not null and t is not null and s <> t")
    both = cut_lineage(both.unionByName(both.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("s").alias("node")).agg(F.min("t").alias("least"))
                         .select("node", F.least("node", "least").alias("label"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("s"), "label"), "s").groupBy(F.col("t").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        before = labels
        labels = cut_lineage(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was")
                             .select("node", "label", (F.col("label") != F.col("was")).alias("moved")))
        drop_lineage(before)
    drop_lineage(both)
    out = labels.select("node", F.col("label").alias("component"))
    out._lineage_path = labels._lineage_path  # a caller may drop what it no longer reads
    return out


def running_sums(values: Column) -> Column:
    """Sums of all values before each position of an array of longs, in two levels of 256 so that long arrays stay cheap."""
    size = F.size(values)
    starts = F.when(size > 0, F.sequence(F.lit(0), F.ceil(size / 256).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)

    def prefix(xs: Column, base: Column) -> Column:
        grown = F.aggregate(xs, F.struct(base.alias("sum"), F.array().cast("array<bigint>").alias("out")),
                            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")))
        return grown["out"]

    blocks = F.transform(starts, lambda i: F.slice(values, i * 256 + 1, F.lit(256)))
    bases = prefix(F.transform(blocks, total), F.lit(0).cast("long"))
    return F.flatten(F.zip_with(blocks, bases, prefix))
