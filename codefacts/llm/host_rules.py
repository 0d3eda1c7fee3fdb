"""Quality rules with a verdict per host, in DataFrame functions only.

Rules are computed inside the row. Their failures are summed per host, the failure rate of every host is shrunk towards a
beta prior fitted to all hosts by moments, and the verdict on the host is joined back to its documents. The failing share
of a host has to be large and well supported before clean documents on it go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import WORD, text_or_empty
from codefacts.session import cut_lineage

SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A host goes when the lower bound of its shrunk failure rate is above this.
HOST_LIMIT = 0.8
_PLACE_BITS = 26


def with_rules(docs: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.

    A null text has no words. ``n_repeat_words`` counts words that lie in a window of three found twice or more: windows
    become longs (38 bits of a hash over a 26-bit position), sorted as numbers; equal neighbours are compared by their
    words, and the covered words follow from the gaps between the positions found. Rows and other columns stay.
    """
    rows = docs.withColumn("_text", text_or_empty())
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", F.when(F.col("_text").contains("\n"), lines).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("word_chars", F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long"))
    rows = rows.withColumn("n_symbols", F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines", "_text")
    span, low = F.lit(1 << _PLACE_BITS).cast("long"), (1 << _PLACE_BITS) - 1

    def window(i: Column) -> Column:
        key = F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
        return key.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i.cast("long"))

    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_keys", F.sort_array(F.transform(places, window)))

    def same(x: Column, y: Column) -> Column:
        equal = F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS)
        place = lambda z, j: F.get("_words", z.bitwiseAND(F.lit(low).cast("long")).cast("int") + j)
        for j in range(3):
            equal = equal & (place(x, j) == place(y, j))
        return F.coalesce(equal, F.lit(False))

    found = F.filter("_keys", lambda x, i: same(x, F.get("_keys", i + 1)) | same(x, F.get("_keys", i - 1)))
    rows = rows.withColumn("_starts", F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.lit(low).cast("long"))))).drop("_keys", "_words")
    covered = F.aggregate("_starts", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), x - s["last"])).alias("n")))
    rows = rows.withColumn("n_repeat_words", covered["n"]).drop("_starts")
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(counts: DataFrame, host: str = "host") -> DataFrame:
    """``counts`` (host, n, failed) with ``shrunk`` rate, ``spread`` (its standard deviation) and ``host_failed``.

    The prior is the beta distribution with the mean of all rows and the variance of the host rates around it, less the
    variance that sampling alone gives. With under two hosts, or no variance beyond sampling, the prior is worth as many
    rows as a host has on average, and at least one.
    """
    total = counts.agg(
        F.sum("failed").alias("f"), F.sum("n").alias("all"), F.count("*").alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).select(
        F.coalesce(F.col("f") / F.col("all"), F.lit(0.0)).alias("_mean"),
        (F.col("ss") - F.col("f") * F.col("f") / F.col("all")).alias("_between"), "hosts", "all", "nn",
    )
    sampling = F.col("_mean") * (1 - F.col("_mean"))
    excess = (F.col("_between") - (F.col("hosts") - 1) * sampling) / (F.col("all") - F.col("nn") / F.col("all"))
    mass = F.when((F.col("hosts") > 1) & (excess > 0) & (sampling > 0), F.greatest(F.lit(1.0), sampling / excess - 1)).otherwise(F.greatest(F.lit(1.0), F.col("all") / F.col("hosts")))
    prior = total.select("_mean", mass.alias("_mass"))
    joined = counts.crossJoin(F.broadcast(prior))  # one row of totals
    a, b = F.col("failed") + F.col("_mean") * F.col("_mass"), F.col("n") - F.col("failed") + (1 - F.col("_mean")) * F.col("_mass")
    rate = a / (a + b)
    joined = joined.withColumn("shrunk", rate).withColumn("spread", F.sqrt(rate * (1 - rate) / (a + b + 1)))
    return joined.withColumn("host_failed", F.col("shrunk") - 2 * F.col("spread") > HOST_LIMIT).drop("_mean", "_mass")


def host_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, the rule counts, ``base_failed``, ``host``, ``host_rate`` and ``kept`` for every row of ``docs``.

    ``kept`` is false where the rules fail or the verdict on the host does. A null host is no host: its rows are judged
    by the rules alone. A host's verdict joins from a table of one row per host; failures are summed before the shuffle.
    Repeated rows count as often as they come. The empty table gives no rows.
    """
    rules = with_rules(docs.select("doc_id", "text", F.col(host).alias("host"))).drop("text")
    rules = cut_lineage(rules)
    counts = rules.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    verdicts = host_verdicts(counts).select("host", F.col("shrunk").alias("host_rate"), "host_failed")
    return rules.join(verdicts, "host", "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).drop("host_failed")
