"""Unified diffs: change level, touched files, comment-only changes.

A diff is one text; its lines are exploded with their position and the window state is per diff. The text of one diff
fits a row, so its lines fit one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.functions.paths import is_build_config

KEY = ["project_id", "diff_id"]


def diff_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """``(project_id, diff_id, pos, line, file, old_line, kind)``; whole texts, no cut.

    Kind: file (``diff --git``), new, deleted, header, hunk, add, del, context or other. ``old_line`` is the line number in
    the old file for del rows: hunk start plus the context and deleted rows before it in the hunk.
    """
    raw = diffs.select(*KEY, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    line = F.col("line")
    file = F.regexp_extract("line", r"^diff --git a/\S+ b/(\S+)$", 1)
    kind = (
        F.when(F.startswith(line, F.lit("diff --git")), "file").when(F.startswith(line, F.lit("new file mode")), "new")
        .when(F.startswith(line, F.lit("deleted file mode")), "deleted").when(F.rlike(line, F.lit(r"^(\+\+\+|---)")), "header")
        .when(F.startswith(line, F.lit("@@")), "hunk").when(F.startswith(line, F.lit("+")), "add").when(F.startswith(line, F.lit("-")), "del")
        .when(F.startswith(line, F.lit(" ")), "context").otherwise("other")
    )
    rows = raw.withColumn("kind", kind)
    w = Window.partitionBy(*KEY).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_file = F.col("kind") == "file"
    rows = rows.withColumn("fno", F.sum(is_file.cast("int")).over(upto)).withColumn(
        "file", F.last(F.when(is_file, file), ignorenulls=True).over(upto)).withColumn("file", F.nullif("file", F.lit("")))
    is_hunk = F.col("kind") == "hunk"
    rows = rows.withColumn("hno", F.sum(is_hunk.cast("int")).over(upto)).withColumn(
        "hstart", F.last(F.when(is_hunk, F.regexp_extract("line", r"^@@ -(\d+)", 1).try_cast("int")), ignorenulls=True).over(upto))
    inside = Window.partitionBy(*KEY, "hno").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("kind").isin("del", "context").cast("int")).over(inside), F.lit(0))
    return rows.withColumn("old_line", F.when(F.col("kind") == "del", F.col("hstart") + seen)).drop("hstart")


def diff_files(lines: DataFrame) -> DataFrame:
    """Files of each diff and how they changed: added, removed or modified."""
    return lines.where("file is not null").groupBy(*KEY, "fno", "file").agg(
        F.bool_or(F.col("kind") == "new").alias("_n"), F.bool_or(F.col("kind") == "deleted").alias("_d")).select(
        *KEY, "file", F.when(F.col("_n"), "added").when(F.col("_d"), "removed").otherwise("modified").alias("change")).distinct()


def classify_diff(diffs: DataFrame, symbols: DataFrame, text: str = "diff") -> DataFrame:
    """Change level of each diff: L0 empty, L1 lines, L2 a removed line starts a symbol, L3 new file or include,
    L4 build configuration; with the number of touched definition files and new files."""
    lines = diff_lines(diffs, text)
    starts = symbols.select("project_id", "file", F.col("start_line").alias("old_line")).distinct()
    touched = lines.where("kind = 'del'").join(starts, ["project_id", "file", "old_line"]).select(*KEY, "file").distinct()
    hit = touched.groupBy(*KEY).agg(F.count("*").alias("touched"))
    agg = lines.groupBy(*KEY).agg(
        F.bool_or((F.col("kind") == "file") & is_build_config(F.coalesce("file", F.lit("")))).alias("cfg"),
        F.bool_or((F.col("kind") == "add") & F.col("file").isNotNull() & F.rlike("line", F.lit("#\\s*include\\s*[<\"']"))).alias("inc"),
        F.count_if((F.col("kind") == "new") & F.col("file").isNotNull()).alias("new_files"), F.bool_or(F.trim("line") != "").alias("any"))
    j = agg.join(hit, KEY, "left").fillna(0, ["touched"])
    level = (
        F.when(~F.col("any"), "L0").when(F.col("cfg"), "L4").when(F.col("inc") | (F.col("new_files") > 0), "L3").when(F.col("touched") > 0, "L2").otherwise("L1")
    )
    return j.select(*KEY, level.alias("level"), "touched", "new_files")


def comment_only(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """Diffs whose changed lines are all comments, blank, or braces and semicolons.

    A line that starts with ``*`` counts as a comment, also ``*p = 1;``. Any ``#`` line is not cosmetic.
    """
    body = F.trim(F.substr("line", F.lit(2)))
    cosmetic = (body == "") | F.rlike(body, F.lit(r"^(//|/\*|\*)")) | F.rlike(body, F.lit(r"^[{}; \t]+$"))
    lines = diff_lines(diffs, text).where(F.col("kind").isin("add", "del"))
    bad = lines.where(~cosmetic).select(*KEY).distinct().withColumn("_bad", F.lit(True))
    return diffs.select(*KEY).distinct().join(bad, KEY, "left").select(*KEY, F.col("_bad").isNull().alias("comment_only"))


def read_diff(diffs: DataFrame, text: str = "diff", review_chars: int = 8000) -> DataFrame:
    """Diff text as reviewed: whole when it fits the review window, with its length and whether it exceeds it."""
    n = F.length(text)
    return diffs.select(*KEY, F.col(text), n.alias("chars"), (n > review_chars).alias("exceeds"))
