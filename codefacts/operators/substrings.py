"""Joins on ``contains`` and ``endswith`` as equi-joins.

A needle of length L is contained in a text exactly when one of the text's substrings of length L equals it. The
texts are expanded once, for the needle lengths that occur under the same key; needles longer than ``KEY`` are looked up
by their first ``KEY`` characters and verified. The needle side is broadcast only after its size was checked; beyond the
limit both sides are shuffled by the substring, without the substrings whose hash no needle has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = 24
BROADCAST_ROWS = 20_000
#: The table of ``maybe_wanted`` has so many words, as a power of two: 16.8 million bits, some 3 MB when sent.
WORD_BITS = 18
#: Words in a row of the table, as a power of two.
SLOT_BITS = 4
SLOTS = 1 << SLOT_BITS


def _is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bit_table(wanted: DataFrame, columns: list[str], bits: int = WORD_BITS) -> DataFrame:
    """``(_p, _words)``: the hashes of the wanted keys as bits of 2 ** ``bits`` words, ``SLOTS`` words a row.

    A hashed relation of single words takes up to 64 bytes for each, one of rows of words some 12.
    """
    hashed = F.xxhash64(*columns)
    word, bit = F.shiftrightunsigned(hashed, 64 - bits), hashed.bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(word.alias("_w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_m"))
    slot = F.col("_w") % SLOTS
    words = [F.coalesce(F.bit_or(F.when(slot == i, F.col("_m"))), F.lit(0).cast("bigint")) for i in range(SLOTS)]
    return marks.groupBy("_w").agg(F.bit_or("_m").alias("_m")).groupBy(F.shiftrightunsigned("_w", SLOT_BITS).alias("_p")).agg(F.array(*words).alias("_words"))


def mark_maybe(rows: DataFrame, table: DataFrame, columns: list[str], bits: int = WORD_BITS) -> DataFrame:
    """``rows`` with ``_maybe``: false only where the ``columns`` do not stand among the keys of ``table`` (see ``bit_table``).

    The table is a broadcast of bounded size, so nothing is shuffled to tell most rows without a partner.
    """
    hashed = F.xxhash64(*columns)
    word, bit = F.shiftrightunsigned(hashed, 64 - bits), hashed.bitwiseAND(F.lit(63)).cast("int")
    marked = rows.withColumn("_p", F.shiftrightunsigned(word, SLOT_BITS)).join(F.broadcast(table), "_p", "left")
    found = F.getbit(F.get("_words", (word % SLOTS).cast("int")), bit) == 1
    return marked.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_p", "_words")


def maybe_wanted(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The ``rows`` whose ``columns`` may stand in ``wanted``; a few others stay, none that stands there is lost."""
    return mark_maybe(rows, bit_table(wanted, columns), columns).where("_maybe").drop("_maybe")


def semi_join(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The ``rows`` whose ``columns`` stand in ``wanted``; beyond the limit of a broadcast, most others go before the shuffle."""
    if _is_small(wanted):
        return rows.join(F.broadcast(wanted), columns, "left_semi")
    return maybe_wanted(rows, wanted, columns).join(wanted, columns, "left_semi")


def _pieces(wanted: DataFrame, texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``texts`` with the distinct substrings ``_k`` of the lengths that the needles with the same ``keys`` have."""
    # at most KEY distinct lengths, so the list of a key is bounded
    lengths = wanted.groupBy(*keys).agg(F.collect_set(F.length("_k")).alias("_lengths"))
    size = F.length(text)

    def of_length(n: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.col(text).substr(i, n))
        return F.when(size >= n, cut).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.transform("_lengths", of_length))
    return texts.join(lengths, keys).withColumn("_k", F.explode(F.array_distinct(pieces))).drop("_lengths")


def contains_pairs(needles: DataFrame, needle: str, texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Distinct ``keys + [needle, text]`` with the needle inside the text (both compared as given)."""
    wanted = needles.select(*keys, needle).where(F.length(needle) > 0).distinct()
    wanted = wanted.withColumn("_k", F.substring(needle, 1, KEY))
    expanded = _pieces(wanted, texts.select(*keys, text).distinct(), text, keys)
    if _is_small(wanted):
        pairs = expanded.join(F.broadcast(wanted), [*keys, "_k"])
    else:
        pairs = maybe_wanted(expanded, wanted, [*keys, "_k"]).join(wanted, [*keys, "_k"])
    exact = (F.length("_k") < KEY) | F.contains(F.col(text), F.col(needle))
    return pairs.where(exact).select(*keys, needle, text)


def first_containing(needles: DataFrame, needle: str, texts: DataFrame, text: str, value: Column, keys: list[str]) -> DataFrame:
    """``keys + [needle, first]``: the least ``value`` among the texts that contain a needle; one row per needle.

    The least value of every wanted substring is taken before anything is joined to the needles, and combined before the
    shuffle: a needle that all texts contain costs one row per task. Needles longer than ``KEY`` are first told apart by
    their first ``KEY`` characters and then verified on the texts that share those.
    """
    wanted = needles.select(*keys, needle).where(F.length(needle) > 0).distinct().withColumn("_k", F.substring(needle, 1, KEY))
    cut = _pieces(wanted, texts.select(*keys, text, value.alias("_v")), text, keys)
    hits = semi_join(cut, wanted.select(*keys, "_k").distinct(), [*keys, "_k"])
    short = hits.where(F.length("_k") < KEY).groupBy(*keys, "_k").agg(F.min("_v").alias("first"))
    long = hits.where(F.length("_k") == KEY).join(wanted.where(F.length(needle) >= KEY), [*keys, "_k"]).where(F.contains(F.col(text), F.col(needle)))
    found = wanted.where(F.length(needle) < KEY).join(short, [*keys, "_k"]).select(*keys, needle, "first")
    return found.unionByName(long.groupBy(*keys, needle).agg(F.min("_v").alias("first")))


def name_suffixes(col: str, at_least: int):
    """All suffixes of a name with at least ``at_least`` characters, the name itself included."""
    n = F.length(col)
    return F.when(
        n >= at_least,
        F.transform(F.sequence(F.lit(1), n - at_least + 1), lambda i: F.col(col).substr(i, n - i + 1)),
    ).otherwise(F.array().cast("array<string>"))
