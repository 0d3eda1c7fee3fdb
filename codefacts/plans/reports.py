"""Text documents from fact tables: one row per project, built from bounded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

P = "project_id"


def _listed(rows: DataFrame, line: Column, order: list, shown: int, out: str) -> DataFrame:
    """First ``shown`` lines of each project as one text; the rank is limited before the shuffle."""
    w = Window.partitionBy(P).orderBy(*order)
    cut = rows.withColumn("_l", line).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= shown)
    return cut.groupBy(P).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_l"))), lambda x: x["_l"]), "\n").alias(out))


def architecture_document(modules: DataFrame, deps: DataFrame, indirect: DataFrame) -> DataFrame:
    """Architecture text: up to 30 modules, 40 dependencies and 20 callback areas.

    ``modules(project_id, module, type, build_status)``.
    """
    mods = _listed(modules, F.concat(F.lit("- `"), "module", F.lit("` ("), "type", F.lit(", build="), "build_status", F.lit(")")), ["module"], 30, "m")
    dep = _listed(deps, F.concat(F.lit("| `"), "from", F.lit("` | `"), "to", F.lit("` | "), F.col("weight").cast("string"), F.lit(" |")), [F.desc("weight"), "from", "to"], 40, "d")
    areas = indirect.groupBy(P, "file", "via").agg(F.min("callee").alias("callee"))
    ind = _listed(areas, F.concat(F.lit("| `"), "file", F.lit("` | "), "via", F.lit(" | `"), "callee", F.lit("` |")), ["file", "via"], 20, "i")
    j = modules.select(P).distinct().join(mods, P, "left").join(dep, P, "left").join(ind, P, "left")
    none = F.lit("> none [Unknown]")
    text = F.concat_ws("\n", F.lit("# System Architecture\n\n## 3. Major Modules"), "m", F.lit("\n## 4. Module Dependencies\n| From | To | Weight |\n|---|---|---:|"), F.coalesce("d", none),
                       F.lit("\n## 7. Callback / Indirect Call Areas\n| File | Via | Callee |\n|---|---|---|"), F.coalesce("i", none))
    return j.select(P, text.alias("text"))


def overview_document(facts: DataFrame) -> DataFrame:
    """Overview text from one row of ``quality.overview_facts`` per project."""
    n = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("# "), P, F.lit("\n\n## 2. Runtime Environment\n- MCU / CPU: `"), F.coalesce("cpu", F.lit("Unknown")), F.lit("`\n- RTOS: `"), F.coalesce("rtos", F.lit("None detected / Unknown")),
                    F.lit("`\n\n## 3. Build Reality\n- Build Target: `"), F.coalesce("target", F.lit("unknown")), F.lit("` [Fact]\n- Project files: `"), n("file_count"), F.lit("` [Fact]\n- Compiled files: `"), n("compiled_count"),
                    F.lit("`\n\n## 7. Engineering Characteristics\n- Module count: `"), n("module_count"), F.lit("` [Fact]\n- Symbol count: `"), n("symbol_count"), F.lit("` [Fact]\n- Call edges: `"), n("call_edge_count"), F.lit("` [Fact]"))
    return facts.select(P, text.alias("text"))


def module_map(modules: DataFrame) -> DataFrame:
    """Module rows in reading order: high, medium, low confidence, then name (``position`` is the sort key)."""
    from codefacts.functions.records import confidence_rank

    return modules.withColumn("position", F.concat_ws(":", confidence_rank("confidence").cast("string"), "module"))
