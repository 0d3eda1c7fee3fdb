"""Name lookups in batches: every operator takes a table of questions and answers them with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions.paths import base_name, norm_path
from codefacts.operators.substrings import first_containing, name_suffixes, semi_join


def match_name(asked: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Best match of ``asked(project_id, ask)`` among ``names(project_id, ord, column)``.

    Exact before case-insensitive before substring; the lowest ``ord`` inside a tier. Adds ``tier`` 0, 1 or 2.
    """
    want = asked.select("project_id", "ask").where(F.trim("ask") != "").distinct().withColumn("_a", F.trim("ask")).withColumn("_low", F.lower("_a"))
    first = names.groupBy("project_id", column).agg(F.min("ord").alias("ord")).withColumn("_n", F.lower(column))
    exact = want.join(first, (want["project_id"] == first["project_id"]) & (want["_a"] == first[column]))
    exact = exact.select(want["project_id"], "ask", F.lit(0).alias("tier"), "ord", column)
    folded = want.join(first, (want["project_id"] == first["project_id"]) & (want["_low"] == first["_n"]))
    folded = folded.select(want["project_id"], "ask", F.lit(1).alias("tier"), "ord", column)
    done = folded.select("project_id", "ask").distinct()
    rest = want.join(done, ["project_id", "ask"], "left_anti")
    hit = first_containing(rest, "_low", first, "_n", F.struct("ord", column), ["project_id"])
    part = rest.join(hit, ["project_id", "_low"]).select("project_id", "ask", F.lit(2).alias("tier"), "first.ord", F.col(f"first.{column}").alias(column))
    every = exact.unionByName(folded).unionByName(part)
    best = every.groupBy("project_id", "ask").agg(F.min(F.struct("tier", "ord", column)).alias("b"))
    return best.select("project_id", "ask", "b.tier", "b.ord", F.col(f"b.{column}").alias(column))


def first_by_name(symbols: DataFrame) -> DataFrame:
    """First symbol of each name: ``(project_id, name, ord, file, type, start_line)``."""
    cols = ["ord", "file", "type", "start_line"]
    return symbols.groupBy("project_id", "name").agg(F.min(F.struct(*cols)).alias("s")).select("project_id", "name", "s.*")


def callers_of(names: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per call of each asked name (not deduplicated)."""
    return names.select("project_id", F.col("name").alias("callee")).distinct().join(calls, ["project_id", "callee"]).select(
        "project_id", F.col("callee").alias("name"), "caller", "file", "line"
    )


def callees_of(names: DataFrame, calls: DataFrame) -> DataFrame:
    return names.select("project_id", F.col("name").alias("caller")).distinct().join(calls, ["project_id", "caller"]).select(
        "project_id", F.col("caller").alias("name"), "callee", "file", "line"
    )


def caller_files_of(names: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct files that define a caller of each name, with the first call that shows it."""
    where = first_by_name(symbols).select("project_id", F.col("name").alias("caller"), F.col("file").alias("caller_file"))
    return (
        callers_of(names, calls).join(where, ["project_id", "caller"])
        .groupBy("project_id", "name", "caller_file").agg(F.min(F.struct("file", "line", "caller")).alias("first"))
        .select("project_id", "name", "caller_file", F.col("first.caller").alias("first_caller"))
    )


def find_file(asked: DataFrame, files: DataFrame) -> DataFrame:
    """File of an asked path: equal normalised path (the last one wins), else the first ending in its base name."""
    want = asked.select("project_id", "ask").distinct().withColumn("_t", norm_path("ask")).withColumn("_b", base_name("_t"))
    have = files.select("project_id", "path", "ord", norm_path("path").alias("_t"))
    exact = have.groupBy("project_id", "_t").agg(F.max_by("path", "ord").alias("exact"))
    tail = have.where(F.contains("_t", F.lit("/"))).groupBy("project_id", base_name("_t").alias("_b")).agg(F.min_by("path", "ord").alias("tail"))
    out = want.join(exact, ["project_id", "_t"], "left").join(tail, ["project_id", "_b"], "left")
    return out.where(F.col("_t") != "").select(
        "project_id", "ask", F.coalesce("exact", "tail").alias("path"), F.col("exact").isNotNull().alias("exact")
    ).where(F.col("path").isNotNull())


def find_symbol(asked: DataFrame, symbols: DataFrame, types: DataFrame) -> DataFrame:
    """Definition of a name: the symbol table, then structs, enums and macros.

    ``types(project_id, kind, name, ord, file, line)`` with kind struct, enum or macro.
    """
    rank = F.when(F.col("kind") == "struct", 1).when(F.col("kind") == "enum", 2).otherwise(3)
    rows = symbols.select("project_id", "name", F.lit(0).alias("rank"), "ord", "type", "file", F.col("start_line")).unionByName(
        types.select("project_id", "name", rank.alias("rank"), "ord", F.col("kind").alias("type"), "file", F.col("line").alias("start_line"))
    )
    best = rows.groupBy("project_id", "name").agg(F.min(F.struct("rank", "ord", "type", "file", "start_line")).alias("b"))
    return asked.select("project_id", F.trim("ask").alias("name")).distinct().join(best, ["project_id", "name"]).select(
        "project_id", F.col("name").alias("ask"), "b.type", "b.file", "b.start_line"
    )


def weak_symbol_match(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """First symbol whose lower-case name ends with the asked one, or the other way round, but is not equal.

    Asked names shorter than four characters match nothing. Both directions are equi-joins on exploded suffixes.
    """
    want = asked.select("project_id", "ask").distinct().withColumn("_a", F.lower(F.trim("ask"))).where(F.length("_a") >= 4)
    have = symbols.select("project_id", "ord", "name", "type", "file", F.lower("name").alias("_n")).where(F.col("_n") != "")
    asks = want.select("project_id", "_a").distinct()
    first = F.min(F.struct("ord", "name", "type", "file")).alias("b")
    # the first symbol of every suffix and of every name is known before the questions are joined: one row per question
    tails = have.select("*", F.explode(name_suffixes("_n", 4)).alias("_a")).where(F.col("_a") != F.col("_n"))
    longer = semi_join(tails, asks, ["project_id", "_a"]).groupBy("project_id", "_a").agg(first)
    whole = have.groupBy("project_id", "_n").agg(first)
    shorter = asks.select("project_id", "_a", F.explode(name_suffixes("_a", 1)).alias("_n")).where(F.col("_a") != F.col("_n")).join(whole, ["project_id", "_n"])
    best = longer.unionByName(shorter.select("project_id", "_a", "b")).groupBy("project_id", "_a").agg(F.min("b").alias("b"))
    return want.join(best, ["project_id", "_a"]).select("project_id", "ask", "b.name", "b.type", "b.file")


def struct_field_usage(asked: DataFrame, fields: DataFrame, usage: DataFrame) -> DataFrame:
    """First definition of a field and the number of functions that read and write it.

    ``fields(project_id, ord, i, struct, file, line, field)``; ``usage(project_id, field, function, access)``.
    """
    want = asked.select("project_id", F.col("ask").alias("field")).distinct()
    first = fields.groupBy("project_id", "field").agg(F.min(F.struct("ord", "i", "struct", "file", "line")).alias("d"))
    used = usage.distinct().groupBy("project_id", "field").agg(
        F.count_if(F.col("access") == "read").alias("readers"), F.count_if(F.col("access") == "write").alias("writers")
    )
    out = want.join(first, ["project_id", "field"], "left").join(used, ["project_id", "field"], "left")
    return out.where(F.col("d").isNotNull() | F.col("readers").isNotNull()).select(
        "project_id", "field", "d.struct", "d.file", "d.line",
        F.coalesce("readers", F.lit(0)).alias("readers"), F.coalesce("writers", F.lit(0)).alias("writers"),
    )


def include_by(asked: DataFrame, includes: DataFrame) -> DataFrame:
    """Sources with an include target of the same base name as ``asked(project_id, path)``."""
    inc = includes.select("project_id", "src", base_name("target").alias("_b")).distinct()
    return asked.select("project_id", "path").distinct().withColumn("_b", base_name("path")).join(inc, ["project_id", "_b"]).select("project_id", "path", "src")


def module_of_file(asked: DataFrame, module_files: DataFrame) -> DataFrame:
    """Module of a path: exact (first module by name), else the base name when exactly one module has it."""
    want = asked.select("project_id", "path").distinct().withColumn("_b", F.substring_index("path", "/", -1))
    exact = module_files.groupBy("project_id", "path").agg(F.min("module").alias("exact"))
    base = module_files.groupBy("project_id", F.substring_index("path", "/", -1).alias("_b")).agg(
        F.min("module").alias("lo"), F.max("module").alias("hi")
    ).where("lo = hi").select("project_id", "_b", F.col("lo").alias("only"))
    out = want.join(exact, ["project_id", "path"], "left").join(base, ["project_id", "_b"], "left")
    return out.select("project_id", "path", F.coalesce("exact", "only").alias("module")).where(F.col("module").isNotNull())


def module_of_symbol(asked: DataFrame, module_symbols: DataFrame) -> DataFrame:
    first = module_symbols.groupBy("project_id", "name").agg(F.min("module").alias("module"))
    return asked.select("project_id", "name").distinct().join(first, ["project_id", "name"])


def enclosing_function(points: DataFrame, functions: DataFrame, block: int = 64) -> DataFrame:
    """Function whose line range holds a point; the innermost (latest start) one.

    Ranges are cut into blocks of lines, so the join is an equi-join on (project, file, block).
    """
    blocks = F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block)))
    spans = functions.select("project_id", "file", "name", "start_line", "end_line", blocks.alias("_k"))
    at = points.withColumn("_k", F.floor(F.col("line") / block))
    hit = at.join(spans, ["project_id", "file", "_k"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hit.groupBy("project_id", "file", "line").agg(F.max(F.struct("start_line", "name")).alias("b"))
    return points.join(best, ["project_id", "file", "line"], "left").select(*points.columns, F.col("b.name").alias("function"))
