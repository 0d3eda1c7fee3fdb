"""Module discovery and the facts that judge a module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions.paths import leaf_dir, stem_of, suffix_of, top_dir
from codefacts.functions.words import classify_module, first_token, is_third_party, leaf_or_ancestor, valid_module_token
from codefacts.operators.relations import module_links
from codefacts.session import cut_lineage

HEADERS = [".h", ".hpp", ".hh"]
SOURCES = [".c", ".cpp", ".cc", ".cxx"]


def symbol_prefixes(names: DataFrame, keys: list[str]) -> DataFrame:
    """Count and first position of each valid first token: ``names(keys…, name, ord)``."""
    rows = names.withColumn("token", first_token("name"))
    return rows.where(valid_module_token("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def top_prefix(names: DataFrame, keys: list[str], at_least: int = 1) -> DataFrame:
    """The most frequent valid token of each group when it covers half of the group's names (ties: first seen).

    ``at_least`` 2 gives the strong prefix of a module, 1 the prefix of a file. Counted in two steps, so a hot
    group is reduced before it is gathered.
    """
    rows = names.withColumn("token", first_token("name"))
    per = rows.groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.max(F.when(valid_module_token("token"), F.struct(F.col("n"), (-F.col("first")).alias("f"), F.col("token"))))
    return (
        per.groupBy(*keys).agg(F.sum("n").alias("total"), best.alias("b"))
        .where((F.col("b.n") >= at_least) & (F.col("b.n") / F.col("total") >= 0.5))
        .select(*keys, F.col("b.token").alias("prefix"))
    )


def prefix_family(names: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of three or more names where one token occurs three times and in half of them."""
    per = names.withColumn("token", first_token("name")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    good = F.rlike("token", F.lit(r"^\p{L}.+$"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("total"), F.coalesce(F.max(F.when(good, F.col("n"))), F.lit(0)).alias("top"))
    return out.select(*keys, ((F.col("total") >= 3) & (F.col("top") >= 3) & (F.col("top") / F.col("total") >= 0.5)).alias("family"))


class Discovery:
    """Result tables of ``discover_modules``; a module is identified by ``(project_id, module_id)``."""

    def __init__(self, modules: DataFrame, files: DataFrame, symbols: DataFrame):
        self.modules = modules
        self.files = files
        self.symbols = symbols


def discover_modules(files: DataFrame, symbols: DataFrame, groups: DataFrame, calls: DataFrame, includes: DataFrame) -> Discovery:
    """Modules from build groups, directories, symbol prefixes and header pairs.

    ``files(project_id, path, ord, scope_type, scope_name)``, ``symbols(project_id, ord, name, file)``,
    ``groups(project_id, path, group)`` (paths already matched to files). Modules that want the same renamed key are
    both kept unless they are linked, so no file is ever lost. Stages that later ones use several times are
    checkpointed, so each is computed once.
    """
    P = "project_id"
    # (a) libraries and files outside the build are frozen under their own names
    frozen = files.where(F.col("scope_type").isin("third_party", "non_build")).select(
        P, "path", "ord", "scope_type",
        F.when(F.col("scope_type") == "third_party", F.coalesce("scope_name", top_dir("path"))).otherwise(
            F.concat(top_dir("path"), F.lit(" (non-build)"))).alias("name"),
    ).withColumn("module_id", F.concat_ws(":", "scope_type", F.lower("name")))
    own = files.where(F.col("scope_type") == "project").select(P, "path", "ord")

    # (b) base name of each project file
    prefix = top_prefix(symbols.select(P, F.col("file").alias("path"), "name", "ord"), [P, "path"])
    grouped = groups.groupBy(P, "path").agg(F.max("group").alias("group"))
    header = suffix_of("path").isin(HEADERS)
    named = own.join(prefix, [P, "path"], "left").join(grouped, [P, "path"], "left").select(
        P, "path", "group", header.alias("header"), stem_of("path").alias("stem"),
        F.struct(header.alias("h"), "ord", "path").alias("pos"),
        F.coalesce("group", F.when(~header, leaf_or_ancestor("path")), F.upper("prefix"), F.when(~header, stem_of("path"))).alias("name"),
    )
    # (c) headers without a name follow the source with the same stem
    sources = named.where(suffix_of("path").isin(SOURCES)).withColumn("key", F.lower("name"))
    opened = sources.groupBy(P, "key").agg(F.min("pos").alias("kpos"), F.min_by("name", "pos").alias("kname"))
    follow = sources.join(opened, [P, "key"]).groupBy(P, "stem").agg(F.min_by("kname", F.struct("kpos", "pos")).alias("follow"))
    base = named.join(follow, [P, "stem"], "left").withColumn("name", F.coalesce("name", "follow", "stem")).withColumn("key", F.lower("name"))
    file_key = cut_lineage(base.select(P, "path", "key", "pos", "name", "group"))

    # (d) symbols go to the module of their file, of the only module with that base name, or of their directory
    bases = file_key.groupBy(P, F.substring_index("path", "/", -1).alias("base")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo = hi")
    at = symbols.select(P, "ord", "name", F.col("file").alias("path"), F.substring_index("file", "/", -1).alias("base"))
    at = at.join(frozen.select(P, "path", F.col("module_id").alias("frozen")), [P, "path"], "left")
    at = at.join(file_key.select(P, "path", F.col("key").alias("fkey")), [P, "path"], "left").join(bases.select(P, "base", F.col("lo").alias("bkey")), [P, "base"], "left")
    stray = F.coalesce(leaf_dir("path"), stem_of("path"))
    placed = at.where((F.col("path") != "") & (F.col("name") != "")).select(
        P, "ord", "name", "path", "frozen", F.coalesce("fkey", "bkey", F.lower(stray)).alias("key"),
        F.when(F.coalesce("fkey", "bkey").isNull(), stray).alias("stray"),
    )
    placed = cut_lineage(placed)
    syms = placed.where("frozen is null").groupBy(P, "key", "name").agg(F.min("ord").alias("ord"), F.max_by("path", "ord").alias("path"))
    late = F.struct(F.lit(True).alias("h"), (F.col("ord") + 4_000_000_000_000_000).alias("ord"), F.col("path"))
    rows = file_key.select(P, "key", "name", "group", "pos", "path").unionByName(
        placed.where("frozen is null and stray is not null").select(P, "key", F.col("stray").alias("name"), F.lit(None).cast("string").alias("group"),
                                                                    late.alias("pos"), F.lit(None).cast("string").alias("path")))
    # (e) library flag from the first file
    mods = rows.groupBy(P, "key").agg(
        F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), F.min_by("group", "pos").alias("group"),
        F.min_by("path", "pos").alias("first_file"))
    mods = mods.withColumn("library", F.coalesce(is_third_party("name", "first_file"), F.lit(False)))

    # (f) rename to the strong prefix; the first module of a wanted key owns it, linked others merge into it
    strong = top_prefix(syms, [P, "key"], 2)
    wanted = mods.join(strong, [P, "key"], "left").withColumn(
        "want", F.when(F.col("group").isNull() & ~F.col("library"), F.coalesce("prefix", "key")).otherwise(F.col("key")))
    owner = wanted.groupBy(P, "want").agg(F.min_by(F.struct("key", "library", "group"), "pos").alias("o")).select(
        P, "want", F.col("o.key").alias("owner"), (F.col("o.library") | F.col("o.group").isNotNull()).alias("closed"))
    links = module_links(
        calls, includes, syms.select(P, "name", F.col("key").alias("module")), file_key.select(P, "path", F.col("key").alias("module")))
    cand = wanted.join(owner, [P, "want"]).withColumn("a", F.least("key", "owner")).withColumn("b", F.greatest("key", "owner"))
    cand = cand.join(links.withColumn("linked", F.lit(True)), [P, "a", "b"], "left")
    merges = (F.col("key") != F.col("owner")) & (F.col("want") != F.col("key")) & ~F.col("closed") & F.coalesce("linked", F.lit(False))
    owns = F.col("key") == F.col("owner")
    resolved = cand.select(
        P, "key", "pos", "group", "library", F.when(merges, F.col("owner")).otherwise(F.col("key")).alias("module_id"),
        F.when(owns & (F.col("want") != F.col("key")), F.upper("want")).otherwise(F.col("name")).alias("name"),
        F.when(owns, F.col("want")).otherwise(F.col("key")).alias("final_key"),
    )
    resolved = cut_lineage(resolved)
    home = resolved.select(P, "key", "module_id")
    heads = resolved.where("key = module_id").drop("key")
    sym_mod = syms.join(home, [P, "key"]).select(P, "module_id", "name", "ord", "path")
    file_mod = file_key.join(home, [P, "key"]).select(P, "module_id", "path", "pos")

    # (g) a symbol whose first token is the key of another ordinary module moves there, with its file
    ordinary = heads.where("group is null and not library")
    target = ordinary.groupBy(P, F.col("final_key").alias("token")).agg(F.min_by("module_id", "pos").alias("target"))
    movable = sym_mod.join(ordinary.select(P, "module_id", F.lit(True).alias("free")), [P, "module_id"], "left").withColumn("token", first_token("name"))
    moved = movable.join(target, [P, "token"], "left").withColumn(
        "to", F.when(F.col("free") & (F.col("target") != F.col("module_id")), F.col("target")))
    moved = cut_lineage(moved.select(P, "module_id", "to", "name", "ord", "path"))
    sym_final = moved.groupBy(P, F.coalesce("to", "module_id").alias("module_id"), "name").agg(F.min("ord").alias("ord"))
    gone = moved.where("to is not null").select(P, "module_id", "path").distinct()
    came = moved.where("to is not null").groupBy(P, F.col("to").alias("module_id"), "path").agg(F.min("ord").alias("ord")).select(
        P, "module_id", "path", late.alias("pos"))
    file_final = file_mod.join(gone, [P, "module_id", "path"], "left_anti").unionByName(came).groupBy(P, "module_id", "path").agg(F.min("pos").alias("pos"))

    # (h) frozen modules join; type, confidence and basis
    frozen_sym = placed.where("frozen is not null").groupBy(P, F.col("frozen").alias("module_id"), "name").agg(F.min("ord").alias("ord"))
    frozen_file = frozen.select(P, "module_id", "path", F.struct(F.lit(False).alias("h"), "ord", "path").alias("pos"))
    frozen_head = frozen.groupBy(P, "module_id", "name", "scope_type").agg(F.min("ord").alias("_o")).drop("_o")
    all_sym, all_file = sym_final.unionByName(frozen_sym), file_final.unionByName(frozen_file)
    heads_all = heads.select(P, "module_id", "name", "group", "library", F.lit("project").alias("scope_type")).unionByName(
        frozen_head.select(P, "module_id", "name", F.lit(None).cast("string").alias("group"), (F.col("scope_type") == "third_party").alias("library"), "scope_type"))
    fstat = all_file.groupBy(P, "module_id").agg(F.count("*").alias("n_files"), F.min_by("path", "pos").alias("first_file"))
    sstat = all_sym.groupBy(P, "module_id").agg(F.count("*").alias("n_symbols"))
    strong2 = top_prefix(all_sym, [P, "module_id"], 2)
    full = heads_all.join(fstat, [P, "module_id"], "left").join(sstat, [P, "module_id"], "left").join(strong2, [P, "module_id"], "left")
    full = full.where(F.col("n_files").isNotNull() | F.col("n_symbols").isNotNull())
    modules = cut_lineage(full.select(
        P, "module_id", "name", "scope_type", F.col("library").alias("third_party"), classify_module("name", "first_file").alias("type"),
        _confidence().alias("confidence"), _basis().alias("basis"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"),
    ))
    names = modules.select(P, "module_id", F.col("name").alias("module"))
    return Discovery(
        modules, all_file.join(names, [P, "module_id"]).select(P, "module_id", "module", "path"),
        all_sym.join(names, [P, "module_id"]).select(P, "module_id", "module", "name", "ord"))


def _confidence() -> Column:
    start = (
        F.when(F.col("group").isNotNull(), 0.95).when(F.col("scope_type") == "third_party", 0.9)
        .when(F.col("scope_type") == "non_build", 0.7).otherwise(0.8)
    )
    raised = F.when(F.col("prefix").isNotNull(), F.least(F.lit(0.95), start + 0.05)).otherwise(start)
    late = F.col("library") & (F.col("scope_type") != "third_party")
    return F.round(F.when(late, 0.9).otherwise(raised), 2)


def _basis() -> Column:
    place = F.coalesce(leaf_dir("first_file"), stem_of("first_file"))
    first = (
        F.when(F.col("group").isNotNull(), F.concat(F.lit("keil_group:"), "group"))
        .when(F.col("scope_type") == "third_party", F.concat(F.lit("scope_config:"), "name"))
        .when(F.col("scope_type") == "non_build", "build_scope:non_build")
        .when(F.col("first_file").isNotNull(), F.concat(F.lit("path:"), place))
    )
    late = F.col("library") & (F.col("scope_type") != "third_party")
    return F.concat_ws(",", first, F.concat(F.lit("prefix:"), "prefix"), F.when(late, "third_party"))


def score_module(facts: DataFrame) -> DataFrame:
    """Confidence of a module from its counts: ``n_entries, n_consumers, n_dependencies, n_symbols, family``."""
    e, c, d, s, fam = (F.col(x) for x in ("n_entries", "n_consumers", "n_dependencies", "n_symbols", "family"))
    some = (c >= 1) | (d >= 1)
    high = (
        ((e >= 2) & (c >= 1) & (d >= 1)) | ((e >= 3) & some) | ((e >= 1) & (c >= 2) & (d >= 1)) | ((e >= 1) & (d >= 2) & (s >= 10))
        | ((e >= 1) & some & F.coalesce(fam, F.lit(False)) & (s >= 10)) | ((e == 0) & (d >= 3) & (c >= 1) & (s >= 10))
    )
    level = F.when(high, "high").when((e >= 1) | (c >= 1) | (d >= 1), "medium").otherwise("low")
    return facts.withColumn("score", level)


def module_evidence(entries: DataFrame, module_symbols: DataFrame, neighbours: DataFrame, module_files: DataFrame, symbols_shown: int = 10) -> DataFrame:
    """Evidence lines of every module in long form: entry points, first symbols, consumers, dependencies, top folder.

    Showing ten symbols is the report's definition; the rank is limited before the shuffle.
    """
    from pyspark.sql.window import Window

    keys = ["project_id", "module"]
    order = Window.partitionBy(*keys).orderBy("ord", "name")
    syms = module_symbols.select(*keys, "name", "ord").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= symbols_shown)
    top = module_files.groupBy(*keys).agg(F.min(top_dir("path")).alias("t"))
    return (
        entries.select(*keys, F.concat(F.lit("entry_point:"), "name").alias("evidence"))
        .unionByName(syms.select(*keys, F.concat(F.lit("symbol:"), "name").alias("evidence")))
        .unionByName(neighbours.select(*keys, F.concat_ws(":", "role", "other").alias("evidence")))
        .unionByName(top.select(*keys, F.concat(F.lit("path:"), "t").alias("evidence")))
    )


def snapshot_of(entries: DataFrame, deps: DataFrame, module_symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Order-free snapshot of a module's facts: one hash per list and the symbol count.

    Lists are reduced to (count, sum of 64-bit hashes) pairs, so no list is gathered and equality does not depend on
    order.
    """
    keys = ["project_id", "module"]

    def digest(df: DataFrame, value: str, out: str) -> DataFrame:
        return df.select(*keys, value).distinct().groupBy(*keys).agg(
            F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64(value).cast("decimal(38,0)")).cast("string")).alias(out))

    d = deps.select("project_id", F.col("from").alias("module"), F.col("to").alias("other"))
    c = deps.select("project_id", F.col("to").alias("module"), F.col("from").alias("other"))
    n = module_symbols.select(*keys, "name").distinct().groupBy(*keys).agg(F.count("*").alias("symbol_count"))
    out = modules.select(*keys)
    for t in (digest(entries, "name", "entry_points"), digest(d, "other", "dependencies"), digest(c, "other", "consumers"), n):
        out = out.join(t, keys, "left")
    return out.fillna("0:0", ["entry_points", "dependencies", "consumers"]).fillna(0, ["symbol_count"])


def entry_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """valid, stale (facts changed) or missing per module; both sides as from ``snapshot_of``."""
    keys = ["project_id", "module"]
    cols = ["entry_points", "dependencies", "consumers", "symbol_count"]
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_has"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_has").isNull(), "missing").when(same, "valid").otherwise("stale")
    return current.join(old, keys, "left").select(*keys, status.alias("status"))


def fallback_responsibility(facts: DataFrame, neighbours: DataFrame, shown: int = 5) -> DataFrame:
    """Factual sentence about a module: counts, first dependencies, first consumers."""
    keys = ["project_id", "module"]
    listed = neighbours.where(F.col("rank") <= shown).groupBy(*keys).agg(
        *[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("rank", "other")))), lambda x: x["other"]), ", ").alias(r)
          for r in ("dependency", "consumer")])
    rows = facts.join(listed, keys, "left")
    e, s = F.col("n_entries"), F.col("n_symbols")
    body = F.concat_ws("、", F.when(e > 0, F.concat(e.cast("string"), F.lit(" 个入口接口"))), F.when(s > 0, F.concat(s.cast("string"), F.lit(" 个符号"))),
                       F.when((e > 0) | (s > 0), F.lit("的业务模块")).otherwise(F.lit("模块")))
    text = F.concat(
        F.lit("包含 "), body, F.when(F.col("dependency") != "", F.concat(F.lit("，依赖 ["), "dependency", F.lit("]"))).otherwise(F.lit("")),
        F.when(F.col("consumer") != "", F.concat(F.lit("，被 ["), "consumer", F.lit("] 调用"))).otherwise(F.lit("")))
    return rows.select(*keys, F.when(F.col("n_symbols").isNotNull(), text).alias("responsibility"))


def planning_view(entries: DataFrame) -> DataFrame:
    """Responsibilities a planner may see: high plain, medium tagged, low hidden; generated facts marked as such.

    ``entries(project_id, module, responsibility, confidence, generated_by)``.
    """
    tag = F.when(F.col("generated_by") == "llm", F.concat(
        F.lit(" [职责置信度="), "confidence", F.lit("]"), F.when(F.col("confidence") == "medium", F.lit("（推断）")).otherwise(F.lit("")))).otherwise(
        F.lit(" [仅事实构成，未做职责判断]"))
    return entries.where(F.col("confidence").isin("high", "medium") & (F.trim("responsibility") != "")).select(
        "project_id", "module", F.concat(F.col("module"), F.lit(": "), F.trim("responsibility"), tag).alias("line"))
