"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all document rates that give every source its target of words, the one closest in relative entropy to taking each
document once (weighted by words) tilts all documents of a source by ``exp(dual of the source)``. The convex dual is solved by
Newton iterations over the table of source totals, which stays distributed: the totals are all that the gradient and the
curvature need. Rates are then rounded into whole copies: along the documents of a source, ordered by size, the
n-th takes the whole copies that the running rate passes, so a source misses its target by about one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.llm.common import text_or_empty, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
NEWTON_ROUNDS = 60
#: Documents of equal size are ranked in so many parts.
PARTS = 1024


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, null last, weigh ``weights`` in turn and share all words. A target above ``most`` times its
    source stops there and the excess goes to the others by weight, until none is above: the sources whose limit per
    weight is smallest stop first, and the rest share what is left.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumn("_w", F.get(cycle, turn % len(weights)).cast("double")).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("_ratio", F.col("_limit") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    ranked = ranked.withColumn("_level", level).withColumn("_at", F.row_number().over(order))
    # the first source that its limit does not stop sets the level of all that follow
    first_open = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_at", "_level"))).over(everything)
    ranked = ranked.withColumn("_first", first_open).withColumn("_open", F.col("_first._level"))
    stopped = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    target = F.when(stopped, F.col("_limit")).otherwise(F.col("_open") * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def source_rates(targets: DataFrame, rounds: int = NEWTON_ROUNDS) -> DataFrame:
    """Adds ``rate`` = exp(dual), where Newton steps bring ``source_size * exp(dual)`` to ``target``.

    The dual of each source is concave and the steps stay between -1 and 1, so they converge from zero. The rate is
    rounded to nine places, which makes reruns and other engines agree. A source without words has rate 0.
    """
    size, target = F.col("source_size").cast("double"), F.col("target")

    def newton(dual: Column, _: Column) -> Column:
        step = (target - size * F.exp(dual)) / (size * F.exp(dual))
        return dual + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))

    dual = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.0), newton)
    return targets.withColumn("rate", F.when((size > 0) & (target > 0), F.round(F.exp(dual), 9)).otherwise(F.lit(0.0)))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words taken, repeats counted).

    One row per row of ``docs``. A null text has size 0 and 0 copies of words; a null source is a source of its own, the
    last. Ties of size go by doc_id. No document is taken more than ``most`` times. Columns of ``docs`` with these names
    are replaced. The empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    rows = docs.select(*own).withColumn("size", word_count(text_or_empty()))
    # One shuffle of the documents serves counts, offsets and ranks; a group is one size of one source, in parts.
    part = F.coalesce(F.pmod(F.col("doc_id"), F.lit(PARTS)), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("_part", part)
    narrow = docs.select("source", word_count(text_or_empty()).alias("size"), part.alias("_part"))
    parts = narrow.groupBy("source", "size", "_part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    rates = source_rates(source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, most))
    earlier = lambda *keys: Window.partitionBy(*keys)
    by_size = sizes.withColumn("_s", F.coalesce(F.sum("n").over(earlier("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_part = parts.withColumn("_p", F.coalesce(F.sum("n").over(earlier("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    offsets = by_part.drop("n").alias("p").join(by_size.drop("n").alias("s"), [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("source", "size")]).select(
        F.col("p.source").alias("_source"), F.col("p.size").alias("_size"), F.col("p._part").alias("_in"), (F.col("_s") + F.col("_p")).alias("_before"))
    offsets = offsets.join(rates, F.col("_source").eqNullSafe(F.col("source"))).select(
        "_source", "_size", "_in", "_before", F.col("source_size").alias("_total"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    inside = F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("doc_id"))
    ranked = rows.withColumn("_rank", inside).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_part") == F.col("_in")))
    position = (F.col("_before") + F.col("_rank")).cast("double")
    copies = (F.floor(position * F.col("_rate")) - F.floor((position - 1) * F.col("_rate"))).cast("long")
    copies = F.least(copies, F.lit(most).cast("long"))
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(
        *[F.col(f"`{c}`") for c in own], "size", F.col("_total").alias("source_size"), F.col("_target").alias("target"), "copies", "taken")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its copies say, with the columns of ``docs``.

    Documents with no words are in no source's budget and come once.
    """
    rows = mixed(docs.withColumns({f"_own_{c}": F.col(c) for c in docs.columns if c in ("size", "source_size", "target", "copies", "taken")}), weights, most)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    repeated = rows.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*[F.col(f"`_own_{c}`").alias(c) if f"_own_{c}" in rows.columns else F.col(f"`{c}`") for c in docs.columns])
