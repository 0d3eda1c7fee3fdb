"""Checks that texts name only allowed identifiers, as joins on exploded prefixes.

The allow-list can be as long as a symbol table, so it is never gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokens(texts: DataFrame) -> DataFrame:
    raw = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))
    named = F.array_distinct(F.filter(raw, lambda t: t != F.lower(t)))
    return texts.select("scope", "id", F.explode(named).alias("token"))


def _prefixes(name: Column) -> Column:
    n = F.length(name)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(3), n), lambda i: name.substr(F.lit(1), i))).otherwise(
        F.array().cast("array<string>")
    )


def _verdict(texts: DataFrame, bad: DataFrame, known: DataFrame | None) -> DataFrame:
    flags = bad.select("scope", "id").distinct().withColumn("_bad", F.lit(True))
    out = texts.select("scope", "id", "text").join(flags, ["scope", "id"], "left")
    ok = F.col("_bad").isNull()
    if known is None:
        return out.select("scope", "id", (ok & (F.col("text") != "")).alias("ok"))
    out = out.join(known.select("scope").distinct().withColumn("_known", F.lit(True)), "scope", "left")
    return out.select("scope", "id", (ok & F.col("_known").isNotNull()).alias("ok"))


def grounded_texts(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """``texts(scope, id, text)`` checked against ``allowed(scope, name)``.

    A token with a capital must equal an allowed name or be a prefix of one; a scope without names rejects all.
    """
    vocabulary = _tokens(texts)
    known = allowed.select("scope", F.explode(_prefixes(F.col("name"))).alias("token")).distinct()
    bad = vocabulary.join(known, ["scope", "token"], "left_anti")
    return _verdict(texts, bad, allowed)


def grounded_prose_texts(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """As ``grounded_texts`` without regard to case and with the prefix relation either way."""
    vocabulary = _tokens(texts).withColumn("up", F.upper("token"))
    upper = allowed.select("scope", F.upper("name").alias("name")).distinct()
    forward = upper.select("scope", F.explode(_prefixes(F.col("name"))).alias("up")).distinct()
    distinct = vocabulary.select("scope", "up").distinct().join(forward, ["scope", "up"], "left_anti")
    back = distinct.select("scope", "up", F.explode(_prefixes(F.col("up"))).alias("name")).join(upper, ["scope", "name"], "left_semi")
    unknown = distinct.join(back.select("scope", "up").distinct(), ["scope", "up"], "left_anti")
    return _verdict(texts, vocabulary.join(unknown, ["scope", "up"], "left_semi"), None)
