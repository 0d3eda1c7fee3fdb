"""Small record mappings: plans, skeleton snapshots, tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_plan(plans: DataFrame) -> DataFrame:
    """Old plan columns (files_involved, risks, verification, steps) in the new form.

    Risks join to one text, the verification becomes the only command, and each step becomes a modify change when
    the plan lists no changes of its own.
    """
    own = F.col("changes") if "changes" in plans.columns else F.lit(None)
    step = F.transform(
        "steps",
        lambda s: F.struct(s["file"].alias("file"), F.lit("").alias("symbol"), F.lit("modify").alias("operation"), s["change"].alias("reason")),
    )
    changes = step if "changes" not in plans.columns else F.when(F.size(own) > 0, own).otherwise(step)
    return plans.select(
        "plan_id", F.col("files_involved").alias("affected_files"), F.array_join("risks", "; ").alias("risk"),
        F.when(F.coalesce("verification", F.lit("")) != "", F.array("verification")).otherwise(F.array().cast("array<string>")).alias("commands"),
        changes.alias("changes"),
    )


def is_skeleton(counts: DataFrame) -> DataFrame:
    """A snapshot that holds files only: no source, no capabilities, no symbols, calls or modules."""
    empty = F.col("codegraph_source").isNull()
    for c in ("capabilities", "symbols", "calls", "modules"):
        empty = empty & (F.col(c) == 0)
    return counts.select("project_id", empty.alias("skeleton"))


def changes_from_tool_results(results: DataFrame) -> DataFrame:
    """Successful results with a path are changes."""
    rows = results.where(F.col("ok") & (F.coalesce("path", F.lit("")) != ""))
    return rows.withColumn("operation", F.when(F.col("append"), "APPEND").otherwise("WRITE")).withColumnRenamed("path", "file")


def evidence_from_tool_results(results: DataFrame) -> DataFrame:
    """Results with an exit code are evidence."""
    return results.where(F.col("exit_code").isNotNull()).withColumn("result", F.when(F.col("exit_code") == 0, "pass").otherwise("fail"))
