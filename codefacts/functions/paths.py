"""Path helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codefacts.functions import fixed


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def any_of(words: list[str]) -> str:
    """Regex alternation of literal words."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def slashes(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def norm_path(path: Column | str) -> Column:
    """Comparison form: forward slashes, no leading run of dots and slashes, lower case."""
    return F.lower(F.regexp_replace(slashes(path), r"^[./]+", ""))


def norm_build_path(path: Column | str) -> Column:
    return F.lower(F.regexp_replace(slashes(path), r"^/+|/+$", ""))


def base_name(path: Column | str) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def suffix_of(path: Column | str) -> Column:
    """Lower-case suffix with its dot; empty when the base name has none (a leading dot is no suffix)."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def stem_of(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]+$", "")


def leaf_dir(path: Column | str) -> Column:
    """Last directory of the path, null for a bare file name."""
    parts = F.split(slashes(path), "/")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))


def top_dir(path: Column | str) -> Column:
    return F.substring_index(slashes(path), "/", 1)


def path_suffixes(path: Column | str) -> Column:
    """Every tail of the path that starts at a path segment, the whole path included."""
    parts = F.split(_c(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"),
    )


def same_file(a: Column | str, b: Column | str) -> Column:
    x, y = slashes(a), slashes(b)
    return (x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x))


def language_of(path: Column | str) -> Column:
    """Language by suffix, else the suffix itself, else ``unknown``."""
    suffix = suffix_of(path)
    table = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv])
    bare = F.regexp_replace(suffix, r"^\.", "")
    return F.coalesce(F.try_element_at(table, suffix), F.when(bare != "", bare), F.lit("unknown"))


def is_header(path: Column | str) -> Column:
    return suffix_of(path).isin(fixed.HEADER_SUFFIXES)


def is_high_risk_header(path: Column | str) -> Column:
    """A header with a telling name or at most two path parts."""
    telling = F.rlike(F.lower(base_name(path)), F.lit(any_of(fixed.HEADER_RISK_WORDS)))
    return is_header(path) & (telling | (F.size(F.split(slashes(path), "/")) <= 2))


def is_build_config(path: Column | str) -> Column:
    """Build files by name or by suffix (a suffix comparison that needs the dot would never match)."""
    base = F.substring_index(_c(path), "/", -1)
    return base.isin(fixed.BUILD_CONFIG_NAMES) | F.lower(F.substring_index(base, ".", -1)).isin(
        fixed.BUILD_CONFIG_SUFFIXES
    )


def is_code_file(path: Column | str) -> Column:
    return suffix_of(path).isin(fixed.CODE_SUFFIXES)


def is_scanned_file(path: Column | str) -> Column:
    """Files the index keeps: source suffix or configuration name, outside the skipped directories."""
    parts = F.split(slashes(path), "/")
    wanted = F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1).isin(fixed.SOURCE_SUFFIXES)
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in fixed.SKIPPED_DIRS]))
    return (wanted | base_name(path).isin(fixed.CONFIG_NAMES)) & ~skipped


def unquote(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(text)), r"^(['\"])(.*)\1$", "$2")


def normalize_scope_path(raw: Column | str) -> Column:
    """Unquoted, forward slashes, no outer slashes, no trailing ``/**``."""
    trimmed = F.regexp_replace(slashes(unquote(raw)), r"^/+|/+$", "")
    return F.regexp_replace(trimmed, r"/+\*\*$", "")


def scope_name_of(path: Column | str, name: Column | None = None) -> Column:
    own = F.substring_index(_c(path), "/", -1)
    if name is None:
        return own
    text = F.trim(F.coalesce(name, F.lit("")))
    return F.when((text == "") | (text == "**"), own).otherwise(text)


def _glob_regex(pattern: Column, any_text: str) -> Column:
    """Shell pattern to regex; ``any_text`` stands for ``*`` (with or without slashes)."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    # "[[]" is a literal bracket; a bracket that opens no class is one too
    escaped = F.regexp_replace(F.replace(escaped, F.lit("[[]"), F.lit("\u0001")), r"\[(?![^\[\]]+\])", r"\\[")
    escaped = F.replace(escaped, F.lit("\u0001"), F.lit("\\["))
    return F.replace(
        F.replace(F.replace(escaped, F.lit("[!"), F.lit("[^")), F.lit("?"), F.lit(".")), F.lit("*"), F.lit(any_text)
    )


def ignore_regex(pattern: Column | str) -> Column:
    """Regex with the meaning of one ignore pattern; compiled once per rule, null for an empty pattern.

    ``dir/**`` is the tree; a bare name is itself or a tree; a slash-less glob is a base name at any depth;
    anything else is a glob over the whole path or a directory.
    """
    pat = F.regexp_replace(slashes(pattern), r"^/+|/+$", "")
    base = F.regexp_replace(pat, r"/+\*\*$", "")
    is_tree = F.endswith(pat, F.lit("/**"))
    name_glob = is_tree & ~F.contains(base, F.lit("/")) & F.contains(base, F.lit("*"))
    eff = F.when(name_glob, base).otherwise(pat)
    full = _glob_regex(eff, ".*")
    literal = F.regexp_replace(base, r"([.+^$(){}|\\*?\[\]])", r"\\$1")
    tree = F.concat(F.lit("^"), literal, F.lit("(?:/.*)?$"))
    bare = F.concat(F.lit("^(?:"), full, F.lit("|"), literal, F.lit("(?:/.*)?)$"))
    by_base = F.concat(F.lit("^(?:"), full, F.lit("|(?:.*/)?"), _glob_regex(eff, "[^/]*"), F.lit(")$"))
    general = F.concat(F.lit("^"), full, F.lit("(?:/.*)?$"))
    return (
        F.when(pat == "", F.lit(None).cast("string"))
        .when(is_tree & ~name_glob, tree)
        .when(~F.contains(eff, F.lit("/")) & ~F.contains(eff, F.lit("*")), bare)
        .when(~F.contains(eff, F.lit("/")), by_base)
        .otherwise(general)
    )


def ignore_match(path: Column | str, pattern: Column | str) -> Column:
    return F.coalesce(F.rlike(slashes(path), ignore_regex(pattern)), F.lit(False))


def resolve_project_path(file_path: Column, file_name: Column, project_dir: Column) -> Column:
    """Path of a build-project entry relative to the root.

    ``\\`` becomes ``/``, the project markers become ``.``; absolute paths and paths that leave the root fall
    back to the bare file name; ``.`` and ``..`` are folded.
    """
    raw = slashes(F.trim(F.coalesce(file_path, F.lit(""))))
    raw = F.replace(F.replace(raw, F.lit("$PROJ_DIR$"), F.lit(".")), F.lit("$PROJ$"), F.lit("."))
    name = slashes(F.trim(F.coalesce(file_name, F.lit(""))))
    wanted = F.when(raw != "", raw).otherwise(name)
    joined = F.concat_ws("/", F.when(project_dir != "", project_dir), wanted)
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(False).alias("outside")
    )

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        empty = F.size(acc["parts"]) == 0
        return F.struct(
            F.when((part == "") | (part == "."), acc["parts"])
            .when(up & ~empty, F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0))))
            .when(up, acc["parts"])
            .otherwise(F.concat(acc["parts"], F.array(part)))
            .alias("parts"),
            (acc["outside"] | (up & empty)).alias("outside"),
        )

    folded = F.aggregate(F.split(joined, "/"), start, step)
    bare = F.when(name != "", name).otherwise(wanted)
    return (
        F.when(wanted == "", F.lit(""))
        .when(F.rlike(wanted, F.lit(r"^(/|.:)")), bare)
        .when(folded["outside"], bare)
        .otherwise(F.array_join(folded["parts"], "/"))
    )
