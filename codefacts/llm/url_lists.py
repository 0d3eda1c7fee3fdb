"""URL filters as a temporal join, in DataFrame functions only.

List entries carry dates and actions. Each entry holds from its date until the next entry for the same rule and list, so
entries become validity intervals. A capture is judged by the entries that were active when it was fetched: by every
suffix of its host, the most specific active rule first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Captures of one host are dealt over so many parts; the intervals of its rules go to each.
SALTS = 16


def host_of(url: str | F.Column):
    """Host of a URL in lower case, without user, port and final dot; null when there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def validity(entries: DataFrame) -> DataFrame:
    """``rule``, ``list``, ``action``, ``since``, ``until`` (exclusive, null: still valid) from dated entries.

    ``entries`` has rule (a host suffix), list, action (block or allow) and day. Of several entries of one rule, list and
    day the last action in code-point order holds, so ``block`` beats ``allow``; repeated entries are one. Entries with a
    null rule, list, day or action say nothing.
    """
    known = entries.where("rule is not null and list is not null and day is not null and action is not null")
    daily = known.groupBy(F.lower("rule").alias("rule"), "list", F.col("day").alias("since")).agg(F.max("action").alias("action"))
    after = Window.partitionBy("rule", "list").orderBy("since")
    return daily.withColumn("until", F.lead("since").over(after))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with ``host``, ``rule``, ``list``, ``action``, ``rule_since`` and ``blocked`` as of the day of fetch.

    Distinct (host, day) pairs are judged once and joined back, so a host with a third of all captures costs one row per
    day. The longest active rule decides, then the latest entry, then block before allow, then the first list. No active rule, a null URL or a
    null day: not blocked, rule null. Rows and other columns stay, repeated rows too; clashing columns are replaced.
    """
    new = ("host", "rule", "list", "action", "rule_since", "blocked")
    own = [c for c in captures.columns if c not in new]
    rows = captures.select(*[F.col(f"`{c}`") for c in own], host_of(F.col(f"`{url}`")).alias("host"))
    asked = rows.select("host", F.col(f"`{day}`").alias("_day")).where("host is not null and _day is not null").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    salt = F.pmod(F.xxhash64("host", "_day"), F.lit(SALTS)).cast("int")
    keys = asked.withColumn("_salt", salt).withColumn("rule", F.explode(suffixes))
    spans = validity(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = keys.join(spans, ["rule", "_salt"]).where("since <= _day and (until is null or _day < until)")
    best = F.max(F.struct(F.length("rule").alias("size"), "since", "action", F.col("rule"))).alias("_best")
    lists = F.min_by("list", F.struct(-F.length("rule"), -F.datediff("since", F.lit("1970-01-01")), F.when(F.col("action") == "block", 0).otherwise(1), "list")).alias("_list")
    verdicts = active.groupBy(F.col("host").alias("_host"), F.col("_day").alias("_on")).agg(best, lists)
    joined = rows.join(verdicts, (F.col("host") == F.col("_host")) & (F.col(f"`{day}`") == F.col("_on")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in own], "host", F.col("_best.rule").alias("rule"), F.col("_list").alias("list"), F.col("_best.action").alias("action"),
        F.col("_best.since").alias("rule_since"), F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"))
