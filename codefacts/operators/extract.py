"""C facts from source text.

Macros and enum members follow patterns; members, functions, bindings and field usage follow the brackets of the text
(``ctext``). What is not seen: macros are not expanded, and both branches of a condition are read as if they followed each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from codefacts.functions.words import is_plain_value, macro_body, macro_kind, macro_name
from codefacts.operators import ctext
from codefacts.sources.readers import source_lines

FILE = ["project_id", "path"]
MAX_BYTES = 5_000_000
NAME = r"[A-Za-z_]\w*"


def size_guard(files: DataFrame, text: str = "text", limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files that are parsed, and error rows for the ones over the size limit."""
    n = F.octet_length(text)
    errors = files.where(n > limit).select(*FILE, F.concat(F.lit("file too large: "), n.cast("string"), F.lit(" bytes")).alias("error"))
    return files.where(n <= limit), errors


def extract_macros(files: DataFrame, text: str = "text") -> DataFrame:
    """Every ``#define`` with its kind, line and unexpanded value."""
    c = F.col("content")
    kind, body = macro_kind(c), macro_body(c)
    rows = source_lines(files, text).where(F.rlike(c, F.lit(r"^\s*#\s*define\s")))
    plain = is_plain_value(body)
    return rows.select(*FILE, macro_name(c).alias("name"), kind.alias("kind"), "line", F.when((kind == "constant") & plain, body).alias("value"),
                       F.when((kind == "function") | ((kind == "constant") & ~plain), body).alias("value_expr")).where("kind is not null")


def _blocks(files: DataFrame, word: str, text: str) -> DataFrame:
    """Bodies of ``word { … } Alias;`` and their name: the typedef alias before the tag; anonymous ones are left out."""
    pattern = rf"(?s)((?:typedef\s+)?\b{word}\b\s*(?:{NAME})?\s*\{{[^{{}}]*\}}\s*(?:{NAME})?\s*;)"
    rows = files.select(*FILE, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("block", "code"))
    tag = F.regexp_extract("code", rf"\b{word}\b\s*({NAME})?\s*\{{", 1)
    alias = F.when(F.startswith("code", F.lit("typedef")), F.regexp_extract("code", rf"(?s)\}}\s*({NAME})?\s*;$", 1)).otherwise("")
    name = F.coalesce(F.nullif(alias, F.lit("")), F.nullif(tag, F.lit("")))
    body = F.regexp_replace(F.regexp_extract("code", r"(?s)\{([^{}]*)\}", 1), r"(?s)/\*.*?\*/|//[^\n]*", "")
    return rows.select(*FILE, "block", name.alias("name"), body.alias("body")).where("name is not null")


def extract_enum_members(files: DataFrame, text: str = "text") -> DataFrame:
    """Enum members: an explicit number keeps its text; implicit ones count on from it (0 first); after an expression
    the value is unknown until the next number."""
    rows = _blocks(files, "enum", text).select(*FILE, F.col("name").alias("enum"), "block", F.posexplode(F.split("body", ",")).alias("pos", "m")).withColumn("m", F.trim(F.regexp_replace("m", r"\s+", " "))).where("m <> ''")
    raw = F.nullif(F.trim(F.regexp_extract("m", r"=(.*)$", 1)), F.lit(""))
    digits = F.regexp_extract(raw, r"^(0[xX][0-9a-fA-F]+|\d+)[uUlL]{0,3}$", 1)
    number = F.when(F.startswith(F.lower(digits), F.lit("0x")), F.conv(F.substr(digits, F.lit(3)), 16, 10).cast("bigint")).otherwise(F.nullif(digits, F.lit("")).cast("bigint"))
    rows = rows.withColumn("raw", raw).withColumn("num", number)
    w = Window.partitionBy(*FILE, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("raw").isNotNull(), F.struct(F.col("pos"), F.col("num"))), ignorenulls=True).over(w)
    rows = rows.withColumn("a", anchor)
    implicit = F.when(F.col("a").isNull(), F.col("pos").cast("bigint")).otherwise(F.col("a.num") + F.col("pos") - F.col("a.pos"))
    value = F.when(F.col("num").isNotNull(), F.col("raw")).when(F.col("raw").isNull(), implicit.cast("string"))
    return rows.select(*FILE, "enum", F.regexp_extract("m", rf"^({NAME})", 1).alias("name"), "pos", value.alias("value"), F.when(F.col("num").isNull(), F.col("raw")).alias("value_expr"))


#: What follows the brackets of a text: how it is found, and its columns.
_FUNCTION = ("name", "start_line", "end_line", "return_type", "parameters", "definition")
BRACKETS: dict[str, tuple[Callable[[ctext.Source], Iterable[dict]], str]] = {
    "fields": (ctext.Source.fields, "struct string, name string, pos int, type string, is_function_pointer boolean, line int"),
    "functions": (lambda s: [{k: f[k] for k in _FUNCTION} for f in s.functions],
                  "name string, start_line int, end_line int, return_type string, parameters array<string>, definition boolean"),
    "usage": (ctext.Source.usage, "line int, field string, access string, function string"),
    "bindings": (ctext.Source.bindings, "line int, name string, via string, field string, caller_hint string"),
}
#: Facts sent to Spark at once; files over the size limit never come here, so a batch stays small.
_AT_ONCE = 5_000


def bracket_facts(files: DataFrame, text: str = "text", kinds: Iterable[str] = tuple(BRACKETS)) -> DataFrame:
    """All facts of ``kinds`` in one pass over the files: ``(project_id, path, kind, <one struct per kind>)``; see ``of_kind``.

    Matching brackets is beyond regular expressions, so it runs in Arrow batches; the brackets of a file are matched once
    for all kinds, a file stays in its task and no line is shuffled. A null text has no facts.
    """
    wanted = {k: BRACKETS[k] for k in kinds}
    target = T.StructType.fromDDL("project_id string, path string, kind string, " + ", ".join(f"{k} struct<{c}>" for k, (_, c) in wanted.items()))
    arrow = to_arrow_schema(target)
    find = {k: f for k, (f, _) in wanted.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            for project, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                source = ctext.Source(content or "")
                own += [{"project_id": project, "path": path, "kind": k, k: fact} for k, f in find.items() for fact in f(source)]
                if len(own) >= _AT_ONCE:
                    yield pa.RecordBatch.from_pylist(own, schema=arrow)
                    own = []
        if own:
            yield pa.RecordBatch.from_pylist(own, schema=arrow)

    return files.select(F.col("project_id").cast("string"), F.col("path").cast("string"), text).mapInArrow(rows, target)


def of_kind(seen: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind among ``bracket_facts``."""
    out = seen.where(F.col("kind") == kind).select(*FILE, f"{kind}.*")
    return out.drop("line") if kind == "fields" else out


def extract_struct_fields(files: DataFrame, text: str = "text") -> DataFrame:
    """Members of structs and unions at any depth of brackets: name, type text with array suffix, function-pointer flag.

    The name is the typedef alias before the tag; anonymous ones are left out, and so are structs inside others. Of
    several declarators the first counts; ``pos`` counts the members from 0.
    """
    return of_kind(bracket_facts(files, text, ["fields"]), "fields")


def extract_functions(files: DataFrame, text: str = "text") -> DataFrame:
    """Function definitions and prototypes, over as many lines as they take, with return type and parameters (unnamed ones
    dropped). A definition ends with its body; a body that is never closed ends with the file."""
    return of_kind(bracket_facts(files, text, ["functions"]), "functions")


def extract_bindings(files: DataFrame, text: str = "text") -> DataFrame:
    """Names bound by a field, table or variable, an initialiser, or a registering call, with the enclosing function."""
    return of_kind(bracket_facts(files, text, ["bindings"]), "bindings")


def extract_field_usage(files: DataFrame, text: str = "text") -> DataFrame:
    """Fields written (the whole left side of an assignment) and read (any other access), with the enclosing function."""
    return of_kind(bracket_facts(files, text, ["usage"]), "usage")
