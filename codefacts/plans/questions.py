"""Questions over the facts, answered in batches: every table is keyed by ``(project_id, query_id)``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.functions import fixed
from codefacts.functions.paths import base_name, slashes
from codefacts.functions.records import compile_from_rank, compile_rank
from codefacts.functions.words import extract_keywords
from codefacts.operators import lookups
from codefacts.operators.substrings import bit_table, contains_pairs, mark_maybe
from codefacts.session import cut_lineage, cut_lineages

Q = ["project_id", "query_id"]
EDGE = ["file", "line", "caller", "callee"]
#: Bits for the pairs of question and symbol: 2 ** 20 words, some 12 MB when sent.
PAIR_BITS = 20


def top(df: DataFrame, order: list, n: int, keys: list[str] = Q) -> DataFrame:
    """First ``n`` rows of each question; the output caps of the answers. Limited before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


class Answers:
    """Lazy hit tables of a batch of questions ``(project_id, query_id, text)``."""

    def __init__(self, questions: DataFrame, symbols: DataFrame, files: DataFrame, calls: DataFrame, includes: DataFrame):
        self.questions = questions
        self.all_symbols, self.all_files, self.calls, self.includes = symbols, files, calls, includes
        words = questions.select(*Q, F.posexplode(extract_keywords("text")).alias("pos", "keyword"))
        self.keywords = words
        # a keyword never holds a line break, so name and qualified name are searched as one text
        named = symbols.withColumn("_t", F.concat_ws("\n", F.lower("name"), F.lower("qualified_name")))
        paths = files.withColumn("_t", F.lower(slashes("path")))
        sym = words.join(contains_pairs(words, "keyword", named, "_t", ["project_id"]), ["project_id", "keyword"]).join(named, ["project_id", "_t"])
        #: symbols with the first keyword that hits; same-named symbols collapse to the last one at the first position
        self.symbols = sym.groupBy(*Q, "name").agg(
            F.min("ord").alias("first_ord"), F.max_by("file", "ord").alias("file"), F.max_by("type", "ord").alias("type"),
            F.min_by("keyword", "pos").alias("hit"))
        fil = words.join(contains_pairs(words, "keyword", paths, "_t", ["project_id"]), ["project_id", "keyword"]).join(paths, ["project_id", "_t"])
        #: files with the first keyword that hits
        self.files = fil.groupBy(*Q, "path").agg(F.min("ord").alias("ord"), F.min_by("keyword", "pos").alias("hit"))

    @cached_property
    def counted(self) -> tuple[DataFrame, DataFrame]:
        """The counted edges and the bits of the hit symbols. Hit symbols, edges and bits are written once: every use reads the same files."""
        once = self.calls.groupBy("project_id", *EDGE, "confidence").agg(F.count("*").alias("n"))
        self.symbols, once = cut_lineages(self.symbols, once)
        return once, cut_lineage(bit_table(self.symbols, [*Q, "name"], PAIR_BITS))

    def _met(self, rows: DataFrame, own: str, other: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``rows(project_id, caller, callee, …)`` by question whose ``own`` end is hit: those whose other end is surely not
        hit, those where it may be, and what is hit. A bounded table tells, so only the second ones need a shuffle by question."""
        table = self.counted[1]
        names = self.symbols.select(*Q, "name")
        cols = [*Q, *[c for c in rows.columns if c != "project_id"]]
        marked = mark_maybe(rows.join(names.withColumnRenamed("name", own), ["project_id", own]).select(*cols), table, [*Q, other], PAIR_BITS)
        return marked.where("not _maybe").select(*cols), marked.where("_maybe").select(*cols), names.withColumnRenamed("name", other)

    def beyond(self, rows: DataFrame, own: str, other: str) -> DataFrame:
        """``rows`` by question whose ``own`` end is hit and whose other end is not."""
        alone, maybe, hit = self._met(rows, own, other)
        return alone.unionByName(maybe.join(hit, [*Q, other], "left_anti").select(*alone.columns))

    @cached_property
    def edges(self) -> DataFrame:
        """Call edges that touch a hit symbol; equal edges keep their number as ``n``.

        Equal edges are counted before the questions meet them, so an edge comes once from either side.
        """
        once = self.counted[0]
        cols = [*Q, *EDGE, "confidence", "n"]
        one, none = F.lit(1), F.lit(0)
        flagged = lambda df, a, b: df.select(*cols, a.alias("hit_caller"), b.alias("hit_callee"))
        alone, maybe, hit = self._met(once, "caller", "callee")
        both = maybe.join(hit.withColumn("_hit", one), [*Q, "callee"], "left")
        return flagged(alone, one, none).unionByName(flagged(both, one, F.coalesce("_hit", none))).unionByName(
            flagged(self.beyond(once, "callee", "caller"), none, one))

    def far_names(self) -> DataFrame:
        """Distinct other ends of calls of hit symbols that are not hit themselves."""
        pairs = self.counted[0].select("project_id", "caller", "callee")
        return self.beyond(pairs, "callee", "caller").select(*Q, F.col("caller").alias("name")).unionByName(
            self.beyond(pairs, "caller", "callee").select(*Q, F.col("callee").alias("name"))).distinct()

    @cached_property
    def _paths(self) -> DataFrame:
        """Distinct pairs of caller and callee with the first files of both."""
        where = lookups.first_by_name(self.all_symbols)
        end = lambda c: where.select("project_id", F.col("name").alias(c), F.col("file").alias(f"{c}_path"))
        pairs = self.counted[0].select("project_id", "caller", "callee").distinct()
        return cut_lineage(pairs.join(end("caller"), ["project_id", "caller"]).join(end("callee"), ["project_id", "callee"]))

    def hit_files(self) -> DataFrame:
        """Files hit by path, by a hit symbol, or by the other end of a call, with the reason that came first.

        The file of the other end is known before the questions are joined, so no name is shuffled by question.
        """
        pairs = self._paths  # first, as it writes the hit symbols
        own = self.files.select(*Q, "path", F.lit(0).alias("step"), F.col("hit").alias("reason"))
        by_symbol = self.symbols.where("file <> ''").groupBy(*Q, F.col("file").alias("path")).agg(
            F.lit(1).alias("step"), F.concat(F.lit("symbol:"), F.min_by("name", "first_ord")).alias("reason"))
        far = self.beyond(pairs, "callee", "caller").select(*Q, F.col("caller_path").alias("path"), F.lit("via:caller").alias("reason")).unionByName(
            self.beyond(pairs, "caller", "callee").select(*Q, F.col("callee_path").alias("path"), F.lit("via:callee").alias("reason")))
        via = far.groupBy(*Q, "path").agg(F.lit(2).alias("step"), F.min("reason").alias("reason"))
        every = own.unionByName(by_symbol).unionByName(via)
        return every.groupBy(*Q, "path").agg(F.min(F.struct("step", "reason")).alias("b")).select(*Q, "path", "b.step", "b.reason")

    def feature_files(self) -> DataFrame:
        """Files hit by path or by the other end of a call."""
        return self.hit_files().where("step <> 1")

    def include_hits(self, files: DataFrame) -> DataFrame:
        """Includes that touch hit files: all of a hit source, else the ones whose target is hit."""
        hits = files.select(*Q, "path")
        out = self.includes.join(hits.withColumnRenamed("path", "src"), ["project_id", "src"]).select(*Q, "src", "target")
        inc = self.includes.join(hits.withColumnRenamed("path", "target"), ["project_id", "target"]).select(*Q, "src", "target")
        return out.unionByName(inc).distinct()


def query_index(a: Answers, max_files: int = 15, max_symbols: int = 25, max_edges: int = 40) -> DataFrame:
    """The part of the index a task touches, in long form ``(…, kind, item, reason, rank)``."""
    files = top(a.hit_files(), ["step", "path"], max_files).select(*Q, F.lit("file").alias("kind"), F.col("path").alias("item"), "reason", "rank")
    syms = top(a.symbols, ["first_ord", "name"], max_symbols).select(*Q, F.lit("symbol").alias("kind"), F.col("name").alias("item"), F.col("hit").alias("reason"), "rank")
    edges = top(a.edges, [*EDGE, "confidence"], max_edges).select(*Q, F.lit("call").alias("kind"), F.concat_ws(" -> ", "caller", "callee").alias("item"), F.col("confidence").alias("reason"), "rank")
    return files.unionByName(syms).unionByName(edges)


def expand_includes(hits: DataFrame, includes: DataFrame) -> DataFrame:
    """``(…, path, reason)``: files that hit files include, and files that include hit files.

    A file counts as hit by path or by base name. ``hits(…, path)``.
    """
    paths = hits.select(*Q, "path").distinct()
    bases = hits.select(*Q, base_name("path").alias("_b")).distinct()
    inc = includes.select("project_id", "src", "target", base_name("src").alias("_sb"), base_name("target").alias("_tb"))
    by_src = inc.join(bases.withColumnRenamed("_b", "_sb"), ["project_id", "_sb"])
    targets = by_src.select(*Q, F.col("target").alias("path"), F.col("_tb").alias("_b")).distinct().join(bases, [*Q, "_b"], "left_anti")
    by_tgt = inc.join(bases.withColumnRenamed("_b", "_tb"), ["project_id", "_tb"])
    sources = by_tgt.select(*Q, F.col("src").alias("path"), F.col("_sb").alias("_b")).distinct().join(bases, [*Q, "_b"], "left_anti")
    return targets.select(*Q, "path", F.lit("included_by").alias("reason")).join(paths, [*Q, "path"], "left_anti").unionByName(
        sources.select(*Q, "path", F.lit("includes").alias("reason")).join(paths, [*Q, "path"], "left_anti"))


def related_modules(hits: DataFrame, includes: DataFrame, n: int = 10) -> DataFrame:
    """Stems of files next to the hits by include, then the hit files' directory names; the first ``n``."""
    near = expand_includes(hits, includes).select(*Q, F.regexp_replace(base_name("path"), r"\.[^.]*$", "").alias("module"), F.lit(0).alias("step"))
    dirs = hits.where(F.contains("path", F.lit("/"))).select(*Q, F.lower(F.element_at(F.split(slashes("path"), "/"), -2)).alias("module"), F.lit(1).alias("step"))
    rows = near.unionByName(dirs).where("module <> ''").groupBy(*Q, "module").agg(F.min("step").alias("step"))
    return top(rows, ["step", "module"], n).select(*Q, "module", "rank")


def search_feature(a: Answers) -> DataFrame:
    """One row per question: what implements the feature, how sure that is, and what to do next.

    A question without keywords or hits keeps its row with low confidence and the reason.
    """
    files = a.feature_files().join(a.all_files.select("project_id", "path", "compile_status"), ["project_id", "path"], "left")
    f = files.groupBy(*Q).agg(
        F.count("*").alias("n_files"), compile_from_rank(F.min(compile_rank(F.coalesce("compile_status", F.lit("unknown"))))).alias("compile_status"),
        F.bool_or(F.col("compile_status") == "excluded").alias("excluded"))
    s = a.symbols.groupBy(*Q).agg(F.count("*").alias("n_symbols"), F.min_by("name", F.struct("first_ord", "name")).alias("feature"))
    e = a.edges.groupBy(*Q).agg(F.sum("n").alias("n_edges"))
    k = a.keywords.groupBy(*Q).agg(F.min_by("keyword", "pos").alias("first_keyword"))
    j = a.questions.select(*Q).join(k, Q, "left").join(s, Q, "left").join(f, Q, "left").join(e, Q, "left").fillna(0, ["n_files", "n_symbols", "n_edges"])
    reason = F.when(F.col("first_keyword").isNull(), "no query keywords extracted").when((F.col("n_files") == 0) & (F.col("n_symbols") == 0), "no matching symbols/files")
    confidence = F.when(reason.isNotNull(), "low").when((F.col("n_symbols") > 0) & (F.col("n_edges") > 0), "high").otherwise("medium")
    status = F.coalesce("compile_status", F.lit("unknown"))
    read = status.isin("excluded", "unknown") | ((F.col("n_symbols") == 0) & (F.col("n_edges") == 0)) | F.coalesce("excluded", F.lit(False))
    return j.select(*Q, F.when(reason.isNull(), F.coalesce("feature", "first_keyword")).alias("feature"), confidence.alias("confidence"), "n_symbols", "n_files", "n_edges",
                    F.when(reason.isNull(), status).alias("compile_status"), F.when((confidence == "low") | read, "read_source").otherwise("answer").alias("recommended_action"), reason.alias("reason"))


def linear_flow(a: Answers) -> DataFrame:
    """Symbols of each question in call order: the first edge that shows them, caller before callee; hit symbols
    without an edge come last, by name.

    The order is given by the columns ``(step, file, line, caller, callee, side, symbol)``. All edges of a hit symbol
    belong to its question, so its first edge is found once per symbol; only the other ends are grouped by question.
    """
    once = a.counted[0]
    first = F.min(F.struct(*EDGE, "side")).alias("p")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("caller").alias("symbol")), F.struct(F.lit(1).alias("side"), F.col("callee").alias("symbol"))))
    shown = once.select("project_id", *EDGE, ends.alias("e")).select("project_id", *EDGE, "e.side", "e.symbol").groupBy("project_id", "symbol").agg(first)
    hit = a.symbols.select(*Q, F.col("name").alias("symbol")).join(shown, ["project_id", "symbol"], "left")
    far = a.beyond(once.select("project_id", *EDGE), "callee", "caller").select(*Q, *EDGE, F.lit(0).alias("side"), F.col("caller").alias("symbol")).unionByName(
        a.beyond(once.select("project_id", *EDGE), "caller", "callee").select(*Q, *EDGE, F.lit(1).alias("side"), F.col("callee").alias("symbol"))).groupBy(*Q, "symbol").agg(first)
    flow = lambda df, step: df.select(*Q, "symbol", step.alias("step"), *[F.col(f"p.{c}").alias(c) for c in (*EDGE, "side")])
    return flow(hit, F.when(F.col("p").isNull(), 1).otherwise(0)).unionByName(flow(far, F.lit(0)))


def topic_of(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    out = None
    for term, topic in fixed.TOPIC_ALIASES:
        hit = F.contains(t, F.lit(term))
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out.otherwise(t)


def search_architecture(a: Answers, startup: DataFrame | None = None) -> DataFrame:
    """Topic, number of flow steps, confidence and action of each question.

    A startup question uses the stored flow ``startup(project_id, pos, step)`` when there is one.
    """
    steps = linear_flow(a).groupBy(*Q).agg(F.count("*").alias("n"))
    is_start = F.rlike("text", F.lit("|".join(fixed.STARTUP_TERMS)))
    j = a.questions.join(steps, Q, "left")
    if startup is not None:
        j = j.join(startup.groupBy("project_id").agg(F.count("*").alias("n_startup")), "project_id", "left")
    else:
        j = j.withColumn("n_startup", F.lit(None).cast("bigint"))
    stored = is_start & (F.coalesce("n_startup", F.lit(0)) > 0)
    n = F.when(stored, F.col("n_startup")).otherwise(F.coalesce("n", F.lit(0)))
    conf = F.when(stored | (n >= 2), "high").when(n == 1, "medium").otherwise("low")
    return j.select(*Q, topic_of("text").alias("topic"), n.alias("steps"), conf.alias("confidence"), F.when(conf == "low", "read_source").otherwise("answer").alias("recommended_action"))


def search_symbol(asked: DataFrame, symbols: DataFrame, calls: DataFrame, files: DataFrame, module_symbols: DataFrame) -> DataFrame:
    """Definition, counts of callers and callees, module, build state, confidence and next action per asked name.

    ``symbols`` carries ``semantic``; a function, struct, enum or macro without it recommends a reindex. Names that
    match nothing keep their row with low confidence.
    """
    best = lookups.match_name(asked, symbols, "name").select("project_id", "ask", "name", "ord")
    info = best.join(symbols.select("project_id", "ord", "file", "type", "start_line", "semantic"), ["project_id", "ord"])
    n = lambda c, o: calls.groupBy("project_id", F.col(c).alias("name")).agg(F.count("*").alias(o))
    cf = lookups.caller_files_of(best.select("project_id", "name"), calls, symbols).groupBy("project_id", "name").agg(F.count("*").alias("n_caller_files"))
    j = info.join(n("callee", "n_callers"), ["project_id", "name"], "left").join(n("caller", "n_callees"), ["project_id", "name"], "left").join(cf, ["project_id", "name"], "left")
    j = j.join(files.select("project_id", F.col("path").alias("file"), "compile_status"), ["project_id", "file"], "left").join(
        lookups.module_of_symbol(best, module_symbols), ["project_id", "name"], "left")
    j = asked.select("project_id", "ask").distinct().join(j, ["project_id", "ask"], "left").fillna(0, ["n_callers", "n_callees", "n_caller_files"])
    linked = (F.col("n_callers") > 0) | (F.col("n_callees") > 0)
    action = (
        F.when(F.col("name").isNull(), "read_source").when(~F.coalesce("semantic", F.lit(False)) & F.col("type").isin("function", "struct", "enum", "macro"), "reindex")
        .when(~linked | (F.col("compile_status") == "excluded"), "read_source").otherwise("answer")
    )
    conf = F.when(F.col("name").isNull(), "low").when(linked, "high").otherwise("medium")
    return j.select("project_id", "ask", "name", "file", "type", "start_line", "module", "compile_status", "n_callers", "n_callees", "n_caller_files",
                    conf.alias("confidence"), action.alias("recommended_action"))


def search_module(asked: DataFrame, modules: DataFrame) -> DataFrame:
    """Module card per asked name; high when the module's own confidence is at least 0.85.

    ``modules(project_id, module, ord, confidence, …)``; unmatched names keep their row.
    """
    best = lookups.match_name(asked, modules, "module").select("project_id", "ask", "module")
    j = asked.select("project_id", "ask").distinct().join(best, ["project_id", "ask"], "left").join(modules.withColumnRenamed("confidence", "_c"), ["project_id", "module"], "left")
    conf = F.when(F.col("module").isNull(), "low").when(F.col("_c") >= 0.85, "high").otherwise("medium")
    return j.withColumn("confidence", conf).withColumn("recommended_action", F.when(F.col("module").isNull(), "read_source").otherwise("answer")).drop("_c", "ord")


def symbol_card(found: DataFrame, calls: DataFrame, shown: int = 20) -> DataFrame:
    """Text card per asked name: definition, the first callers and callees, confidence."""
    key = ["project_id", "ask"]
    named = found.where("name is not null").select(*key, "name")

    def first(role: str, own: str, other: str) -> DataFrame:
        rows = named.join(calls.select("project_id", F.col(own).alias("name"), F.col(other).alias("o"), "file", "line"), ["project_id", "name"])
        cut = top(rows, ["file", "line", "o"], shown, key)
        return cut.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "o"))), lambda x: F.concat(F.lit("  "), x["o"], F.lit("()"))), "\n").alias(role))

    j = found.where("name is not null").join(first("callers", "callee", "caller"), key, "left").join(first("callees", "caller", "callee"), key, "left")
    none = F.lit("  (none)")
    card = F.concat_ws("\n", F.lit("Evidence:"), F.lit(""), F.lit("[Definition]"), F.concat(F.lit("  File: "), "file"), F.concat(F.lit("  Line: "), F.col("start_line").cast("string")), F.lit(""),
                       F.lit("[Callers]"), F.coalesce("callers", none), F.lit(""), F.lit("[Callees]"), F.coalesce("callees", none), F.lit(""), F.concat(F.lit("Confidence: "), "confidence"))
    return j.select(*key, card.alias("card"))


def symbol_impact(a: Answers, module_symbols: DataFrame, indirect: DataFrame) -> DataFrame:
    """Evidence row of every symbol a question touches: hit ones directly, the other ends of their calls indirectly."""
    far = a.far_names().select("*", F.lit("indirect").alias("impact"))
    names = a.symbols.select(*Q, "name", F.lit("direct").alias("impact")).unionByName(far)
    last = a.all_symbols.groupBy("project_id", "name").agg(F.max_by(F.struct("file", "type"), "ord").alias("s"))
    cnt = lambda own, other, out: a.calls.select("project_id", F.col(own).alias("name"), other).distinct().groupBy("project_id", "name").agg(F.count("*").alias(out))
    regs = indirect.groupBy("project_id", F.col("callee").alias("name")).agg(F.count("*").alias("registered_by"))
    inc = a.includes.select("project_id", base_name("target").alias("_b"), "src").distinct().groupBy("project_id", "_b").agg(F.count("*").alias("include_by"))
    facts = last.select("project_id", "name", "s.file", "s.type", base_name("s.file").alias("_b")).join(cnt("callee", "caller", "callers"), ["project_id", "name"], "left").join(
        cnt("caller", "callee", "callees"), ["project_id", "name"], "left").join(regs, ["project_id", "name"], "left").join(inc, ["project_id", "_b"], "left")
    facts = facts.join(a.all_files.select("project_id", F.col("path").alias("file"), "compile_status"), ["project_id", "file"], "left").join(
        lookups.module_of_symbol(last, module_symbols), ["project_id", "name"], "left").fillna(0, ["callers", "callees", "registered_by", "include_by"])
    return names.join(facts, ["project_id", "name"]).select(
        *Q, "name", "impact", "file", "type", "module",
        F.coalesce("compile_status", F.lit("unknown")).alias("compile_status"), "callers", "callees", "registered_by", "include_by")


def module_impact(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Modules a question touches: direct when a file or a hit symbol lies in it. ``files(…, module)``."""
    rows = symbols.where("module is not null").select(*Q, "module", F.when(F.col("impact") == "direct", 0).otherwise(1).alias("r")).unionByName(
        files.where("module is not null").select(*Q, "module", F.lit(0).alias("r")))
    return rows.groupBy(*Q, "module").agg(F.when(F.min("r") == 0, "direct").otherwise("indirect").alias("impact"))


def with_legacy_action(answers: DataFrame) -> DataFrame:
    """Adds the older plain-text column for the next action."""
    return answers.withColumn("recommended_next_action", F.col("recommended_action"))
