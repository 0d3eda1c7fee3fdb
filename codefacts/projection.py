"""Fact tables derived from the driver's Parquet tables (see FIXTURES.md §2)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions.records import confidence_level
from codefacts.session import cut_lineage, fine_shuffles, measured_session

PROJECT = "firmware"


class Facts:
    """Lazy fact tables over one data folder; nothing is read until a table is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = measured_session(spark)
        self.folder = folder

    def shared(self, *names: str) -> None:
        """Writes the named facts once, for queries that read them in many places."""
        for name in names:
            self.__dict__[name] = cut_lineage(getattr(self, name))

    def shared_calls(self) -> None:
        """Writes once what links two ends of a call, for queries that read calls in many places and need nothing else of them."""
        if not hasattr(self.calls, "_lineage_path"):
            self.__dict__["calls"] = cut_lineage(self.calls.select("project_id", "caller", "callee", "file", "callee_file", "confidence"))

    def fine_shuffles(self) -> None:
        """Shuffle partitions by the size of the calls, for queries whose tasks hold many wide rows."""
        size = self.table("lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        fine_shuffles(self.spark, int(str(size)))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def symbols(self) -> DataFrame:
        k = F.col("p_partkey")
        area = (
            F.when(k % 4 == 0, "Drivers/BSP").when(k % 4 == 1, "App").when(k % 4 == 2, "Middlewares/LVGL")
            .otherwise("User/hmi")
        )
        brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
        tail = F.when(k % 5 == 0, ".h").otherwise(".c")
        kind = F.when(k % 5 == 0, "macro").when(k % 5 == 1, "struct").when(k % 5 == 2, "enum").otherwise("function")
        name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string"))
        return self.table("part").select(
            F.lit(PROJECT).alias("project_id"), k.alias("ord"), name.alias("name"),
            F.concat(brand, F.lit("::"), name).alias("qualified_name"),
            kind.alias("type"),
            F.concat(area, F.lit("/"), brand, F.lit("/"), F.lower("p_type"), F.lit("_"), (k % 7).cast("string"), tail)
            .alias("file"),
            F.col("p_size").alias("start_line"), (F.col("p_size") + 9).alias("end_line"), brand.alias("module"),
        )

    @cached_property
    def files(self) -> DataFrame:
        m = F.col("ord") % 4
        return (
            self.symbols.groupBy("project_id", F.col("file").alias("path"))
            .agg(F.min("ord").alias("ord"))
            .withColumn(
                "compile_status", F.when(m == 2, "not_compiled").when(m == 3, "excluded").otherwise("compiled")
            )
            .withColumn(
                "scope_type", F.when(F.startswith("path", F.lit("Middlewares/")), "third_party").otherwise("project")
            )
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Each order line is one call: its part calls the symbol numbered like the order's customer."""
        sym = self.symbols
        a = sym.select(F.col("ord").alias("l_partkey"), F.col("name").alias("caller"), "file", "module")
        b = sym.select(
            F.col("ord").alias("o_custkey"), F.col("name").alias("callee"), F.col("file").alias("callee_file"),
            F.col("module").alias("callee_module"),
        )
        line = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag"
        )
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        score = F.when(F.col("l_returnflag") != "R", F.round(1 - 6 * F.col("l_discount"), 2))
        return (
            line.join(orders, "l_orderkey").join(a, "l_partkey").join(b, "o_custkey")
            .select(
                F.lit(PROJECT).alias("project_id"), "caller", "callee", "file", "callee_file", "module",
                "callee_module", F.col("l_linenumber").alias("line"), score.alias("confidence_score"),
                confidence_level(score).alias("confidence"),
            )
        )

    @cached_property
    def includes(self) -> DataFrame:
        return (
            self.calls.where(F.endswith("callee_file", F.lit(".h")) & (F.col("file") != F.col("callee_file")))
            .select("project_id", F.col("file").alias("src"), F.col("callee_file").alias("target")).distinct()
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """Code-graph nodes: the symbols and one file node per file."""
        none = F.lit(None).cast("string")
        sym = self.symbols.select(
            "project_id", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("id"), F.col("type").alias("kind"), "name",
            "qualified_name", F.col("file").alias("file_path"), "start_line", "end_line", none.alias("signature"),
        )
        one = F.lit(1).cast("int")
        file = self.files.select(
            "project_id", F.concat(F.lit("f:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"),
            F.col("path").alias("qualified_name"), F.col("path").alias("file_path"), one.alias("start_line"), one.alias("end_line"),
            none.alias("signature"),
        )
        return sym.unionByName(file)

    @cached_property
    def edges(self) -> DataFrame:
        """Code-graph edges: one call per order line with its score as JSON, and the file includes."""
        score = F.round(1 - 6 * F.col("l_discount"), 2).cast("string")
        meta = F.when(F.col("l_returnflag") != "R", F.concat(F.lit('{"confidence":'), score, F.lit("}"))).otherwise("{broken")
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        call = self.table("lineitem").join(orders, "l_orderkey").select(
            F.lit(PROJECT).alias("project_id"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("source"),
            F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("target"), F.lit("calls").alias("kind"),
            meta.alias("metadata"), F.col("l_linenumber").alias("line"),
        )
        inc = self.includes.select(
            "project_id", F.concat(F.lit("f:"), "src").alias("source"), F.concat(F.lit("f:"), "target").alias("target"),
            F.lit("imports").alias("kind"), F.lit(None).cast("string").alias("metadata"), F.lit(1).alias("line"),
        )
        return call.unionByName(inc)

    @cached_property
    def field_usage(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.concat(F.lower("p_type"), F.lit("_f"), (F.col("p_partkey") % 50).cast("string")).alias("field"),
        )
        fn = self.symbols.select(F.col("ord").alias("l_suppkey"), F.col("name").alias("function"))
        return (
            self.table("lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
            .join(part, "l_partkey").join(fn, "l_suppkey")
            .select(
                F.lit(PROJECT).alias("project_id"), "field", "function",
                F.when(F.col("l_linestatus") == "F", "write").otherwise("read").alias("access"),
            ).distinct()
        )

    @cached_property
    def bindings(self) -> DataFrame:
        """A symbol (numbered like the supplier) is bound at a place inside the part's file."""
        sym = self.symbols
        name = sym.select(F.col("ord").alias("l_suppkey"), "name")
        place = sym.select(F.col("ord").alias("l_partkey"), "file", F.col("name").alias("caller_hint"))
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.concat(F.lower("p_type"), F.lit("_f"), (F.col("p_partkey") % 50).cast("string")).alias("field"),
        )
        via = (
            F.when(F.col("l_returnflag") == "A", "field_assign").when(F.col("l_returnflag") == "N", "table_assign")
            .otherwise("register_call")
        )
        return (
            self.table("lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
            .join(name, "l_suppkey").join(place, "l_partkey").join(part, "l_partkey")
            .select(
                F.lit(PROJECT).alias("project_id"), "name", via.alias("via"), "file",
                F.col("l_linenumber").alias("line"), "caller_hint",
                F.when(via == "field_assign", F.col("field")).otherwise("").alias("field"),
            )
        )

    @cached_property
    def struct_fields(self) -> DataFrame:
        """Every struct symbol has three fields, named after its part type."""
        part = self.table("part").select(F.col("p_partkey").alias("ord"), F.lower("p_type").alias("t"))
        rows = self.symbols.where(F.col("type") == "struct").join(part, "ord")
        offset = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
        return rows.select("*", offset.alias("i")).select(
            "project_id", "ord", F.col("name").alias("struct"), "file", "i",
            F.concat("t", F.lit("_f"), ((F.col("ord") + F.col("i")) % 50).cast("string")).alias("field"),
            (F.col("start_line") + F.col("i") + 1).alias("line"),
        )

    @cached_property
    def events(self) -> DataFrame:
        t = F.col("event_type")
        kind = (
            F.when(t == "click", "ToolStarted").when(t == "view", "ToolFinished").when(t == "signup", "TaskStateChanged")
            .when(t == "purchase", "TestFinished").otherwise("FindingCreated")
        )
        return self.table("events").select(
            F.lit(PROJECT).alias("project_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("task_id"), "ts",
            kind.alias("type"), "value", F.col("props").alias("payload"),
        )

    @cached_property
    def plan_changes(self) -> DataFrame:
        first = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("ord_sym"))
        sym = self.symbols.select(F.col("ord").alias("ord_sym"), "name", "file")
        return (
            self.table("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(sym, "ord_sym")
            .select(
                F.lit(PROJECT).alias("project_id"), F.col("o_custkey").alias("plan_id"),
                F.col("o_orderkey").alias("ord"), "file",
                F.when(F.col("o_orderpriority") == "5-LOW", "missing_symbol").otherwise(F.col("name")).alias("symbol"),
                F.when(F.col("o_orderstatus") == "P", "add").otherwise("modify").alias("operation"),
            )
        )

    @cached_property
    def sources(self) -> DataFrame:
        """A source tree of all documents: the project is the document's source."""
        path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", ".h").otherwise(".c")))
        return self.table("documents").select(F.col("source").alias("project_id"), path.alias("path"), "text")

    @cached_property
    def file_versions(self) -> tuple[DataFrame, DataFrame]:
        """Two versions of a source tree: toxic documents are gone, those without a label are new, and good ones
        are edited."""
        docs = self.table("documents").join(self.table("labels"), "doc_id", "left")
        path = F.concat_ws(
            "/", "source", "lang",
            F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", ".h").otherwise(".c")),
        )
        old = docs.where(F.col("quality").isNotNull()).select(
            F.col("source").alias("project_id"), path.alias("path"), "text"
        )
        edited = F.when(F.col("quality") == 1, F.concat("text", F.lit(" // edit"))).otherwise(F.col("text"))
        new = docs.where(F.coalesce(F.col("toxic"), F.lit(0)) == 0).select(
            F.col("source").alias("project_id"), path.alias("path"), edited.alias("text")
        )
        return old, new

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.lit(PROJECT).alias("project_id"), F.col("conv_id").alias("task_id"), F.col("turn").alias("ord"),
            F.col("role").alias("sender"), F.col("text").alias("content"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        """One question per customer: its market segment and its number, which names symbols."""
        return self.table("customer").select(
            F.lit(PROJECT).alias("project_id"), F.col("c_custkey").alias("query_id"),
            F.concat(F.lit("fix the "), F.lower("c_mktsegment"), F.lit(" of _"), F.col("c_custkey").cast("string")).alias("text"),
        )
