"""A corpus from documents to packed sequences: each stage works on what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codefacts.llm import mixing, order_minhash, packing, pii, toxicity
from codefacts.llm.catalog import fold
from codefacts.llm.common import table
from codefacts.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it is fitted on the labelled rows of ``docs``."""
    weights = toxicity.fitted(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return toxicity.without_toxic(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id."""
    return order_minhash.without_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target asks."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens; a document that came twice is packed twice."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("personal data", mask_personal_data), ("mixing", mix_sources), ("packing", pack),
]

#: The classifier, the alignment and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
