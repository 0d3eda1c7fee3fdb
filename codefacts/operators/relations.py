"""Relations between modules: dependencies, consumers, entry points, build state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.functions.records import compile_from_rank, compile_rank
from codefacts.operators.substrings import semi_join
from codefacts.session import cut_lineage


def _call_links(calls: DataFrame, module_symbols: DataFrame, module_files: DataFrame | None) -> DataFrame:
    """Call counts by module of the caller and by callee, with the module of the callee: ``(project_id, m1, callee, m2, n, n_high)``.

    The module of the caller replaces its name before anything else is shuffled, so calls from one module to one callee travel
    once; only calls from names without a module are joined by file.
    """
    names = module_symbols.groupBy("project_id", "name").agg(F.max("module").alias("module"))
    a = names.select("project_id", F.col("name").alias("caller"), F.col("module").alias("m1"))
    b = names.select("project_id", F.col("name").alias("callee"), F.col("module").alias("m2"))
    counts = [F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("n_high")]
    known = a.where(F.col("m1").isNotNull())
    pairs = calls.select("project_id", "caller", "callee", "confidence").join(known, ["project_id", "caller"]).groupBy("project_id", "m1", "callee").agg(*counts)
    if module_files is not None:
        by_file = module_files.groupBy("project_id", F.col("path").alias("file")).agg(F.max("module").alias("m1")).where(F.col("m1").isNotNull())
        strange = calls.select("project_id", "caller").where(F.col("caller").isNotNull()).distinct().join(known, ["project_id", "caller"], "left_anti")
        rows = calls.select("project_id", "caller", "callee", "file", "confidence")
        lost = semi_join(rows, strange, ["project_id", "caller"]).unionByName(rows.where(F.col("caller").isNull()).select("project_id", "caller", "callee", "file", "confidence"))
        lost = lost.groupBy("project_id", "file", "callee").agg(*counts).join(by_file, ["project_id", "file"])
        pairs = pairs.unionByName(lost.select(*pairs.columns))
    return pairs.join(b, ["project_id", "callee"])


def _include_links(includes: DataFrame, module_files: DataFrame) -> DataFrame:
    by_file = module_files.groupBy("project_id", "path").agg(F.max("module").alias("m"))
    a = by_file.select("project_id", F.col("path").alias("src"), F.col("m").alias("m1"))
    b = by_file.select("project_id", F.col("path").alias("target"), F.col("m").alias("m2"))
    return includes.select("project_id", "src", "target").distinct().join(a, ["project_id", "src"]).join(b, ["project_id", "target"])


def dependency_via(calls: DataFrame, includes: DataFrame, module_symbols: DataFrame, module_files: DataFrame) -> DataFrame:
    """Long form of the dependencies: one row per (from, to, kind, via) with its weight.

    A call weighs 3, one more at high confidence; an include weighs 2. Edges inside a module are left out.
    """
    keys = ["project_id", F.col("m1").alias("from"), F.col("m2").alias("to")]
    call = _call_links(calls, module_symbols, module_files).where("m1 <> m2").groupBy(
        *keys, F.lit("call").alias("kind"), F.col("callee").alias("via")).agg(F.sum(3 * F.col("n") + F.col("n_high")).alias("weight"))
    inc = _include_links(includes, module_files).where("m1 <> m2").groupBy(
        *keys, F.lit("include").alias("kind"), F.col("target").alias("via")).agg(F.sum(F.lit(2)).alias("weight"))
    return call.unionByName(inc)


def module_dependencies(via: DataFrame) -> DataFrame:
    """Weight, kinds and number of distinct vias per ordered module pair."""
    named = via.groupBy("project_id", "from", "to", "via").agg(
        F.sum("weight").alias("w"), F.bool_or(F.col("kind") == "call").alias("c"), F.bool_or(F.col("kind") == "include").alias("i"))
    kinds = F.concat_ws(",", F.when(F.bool_or("c"), F.lit("call")), F.when(F.bool_or("i"), F.lit("include")))
    return named.groupBy("project_id", "from", "to").agg(
        F.sum("w").alias("weight"), kinds.alias("kinds"), F.count("*").alias("via_count"))


def ranked_neighbours(deps: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` dependencies and consumers of every module, heaviest first, ties by name."""
    both = deps.select("project_id", F.col("from").alias("module"), F.lit("dependency").alias("role"), F.col("to").alias("other"), "weight").unionByName(
        deps.select("project_id", F.col("to").alias("module"), F.lit("consumer").alias("role"), F.col("from").alias("other"), "weight"))
    order = Window.partitionBy("project_id", "module", "role").orderBy(F.desc("weight"), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def neighbour_lists(deps: DataFrame) -> DataFrame:
    """All dependencies and consumers of every module as arrays, heaviest first, ties by name; modules of a project bound them."""
    both = deps.select("project_id", F.col("from").alias("module"), F.struct(-F.col("weight"), F.col("to").alias("other")).alias("d"), F.lit(None).alias("c")).unionByName(
        deps.select("project_id", F.col("to").alias("module"), F.lit(None).alias("d"), F.struct(-F.col("weight"), F.col("from").alias("other")).alias("c")))
    names = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["other"])
    return both.groupBy("project_id", "module").agg(names("d").alias("dependencies"), names("c").alias("consumers"))


def module_links(calls: DataFrame, includes: DataFrame, module_symbols: DataFrame, module_files: DataFrame) -> DataFrame:
    """Distinct unordered pairs of modules that call or include each other: ``(project_id, a, b)`` with a < b."""
    pairs = _call_links(calls, module_symbols, None).select("project_id", "m1", "m2").unionByName(
        _include_links(includes, module_files).select("project_id", "m1", "m2"))
    return pairs.where("m1 <> m2").select("project_id", F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")).distinct()


def entry_points(calls: DataFrame, module_symbols: DataFrame, top: int = 3) -> DataFrame:
    """Symbols called from outside their module that call nothing inside it: the ``top`` by outside calls.

    ``module_symbols(project_id, module, name, ord)``.
    """
    own = module_symbols.select("project_id", "module", "name", "ord").distinct()
    callee = own.select("project_id", F.col("name").alias("callee"), "module", "ord")
    caller = own.select("project_id", F.col("name").alias("caller"), "module").distinct().withColumn("inside", F.lit(True))
    linked = calls.select("project_id", "caller", "callee").join(callee, ["project_id", "callee"]).join(caller, ["project_id", "caller", "module"], "left")
    inside = F.coalesce("inside", F.lit(False))
    # a call inside a module marks its caller, one from outside counts for its callee: one table of the size of the symbols
    told = linked.select("project_id", "module", F.when(inside, F.col("caller")).otherwise(F.col("callee")).alias("name"), F.when(~inside, F.col("ord")).alias("ord"), inside.alias("inside"))
    told = cut_lineage(told.groupBy("project_id", "module", "name", "ord", "inside").agg(F.count("*").alias("outside_calls")))
    busy = told.where("inside").select("project_id", "module", "name").distinct()
    order = Window.partitionBy("project_id", "module").orderBy(F.desc("outside_calls"), "ord")
    return told.where("not inside").drop("inside").join(busy, ["project_id", "module", "name"], "left_anti").select(
        "project_id", "module", "name", "ord", "outside_calls").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def build_stats(module_files: DataFrame, files: DataFrame) -> DataFrame:
    """Best compile status, number of compiled files and number of files of each module."""
    known = files.select("project_id", "path", "compile_status")
    return module_files.distinct().join(known, ["project_id", "path"], "left").groupBy("project_id", "module").agg(
        compile_from_rank(F.min(compile_rank(F.coalesce("compile_status", F.lit("unknown"))))).alias("build_status"),
        F.count_if(F.col("compile_status") == "compiled").alias("compiled"), F.count("*").alias("total"))


def module_facts(modules: DataFrame, module_symbols: DataFrame, module_files: DataFrame, deps: DataFrame, entries: DataFrame) -> DataFrame:
    """Counts a module is judged by: symbols, files, entry points, dependencies, consumers."""
    keys = ["project_id", "module"]
    syms = module_symbols.select(*keys, "name").distinct().groupBy(*keys).agg(F.count("*").alias("n_symbols"))
    fls = module_files.select(*keys, "path").distinct().groupBy(*keys).agg(F.count("*").alias("n_files"))
    out = deps.groupBy("project_id", F.col("from").alias("module")).agg(F.count("*").alias("n_dependencies"))
    inc = deps.groupBy("project_id", F.col("to").alias("module")).agg(F.count("*").alias("n_consumers"))
    ent = entries.groupBy(*keys).agg(F.count("*").alias("n_entries"))
    joined = modules
    for t in (syms, fls, out, inc, ent):
        joined = joined.join(t, keys, "left")
    return joined.fillna(0, ["n_symbols", "n_files", "n_dependencies", "n_consumers", "n_entries"])
