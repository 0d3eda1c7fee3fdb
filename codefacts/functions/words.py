"""Keywords, tokens, names and grounding checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codefacts.functions import fixed
from codefacts.functions.paths import _c, any_of, base_name, slashes, suffix_of  # noqa: F401


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _split_name(token: Column) -> Column:
    """Camel and underscore parts; a camel boundary keeps both halves in one part, joined by a blank."""
    return F.split(F.regexp_replace(token, r"([a-z0-9])([A-Z])", "$1 $2"), "_")


def extract_keywords(text: Column | str) -> Column:
    """Query words of a text in first-seen order, then the aliases of its Chinese terms."""
    raw = F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    kept = F.filter(raw, lambda t: ~F.lower(t).isin(fixed.STOP_WORDS))
    # most words have neither an underscore nor a capital: they need no pattern
    simple = lambda t: (F.lower(t) == t) & ~F.contains(t, F.lit("_"))
    parts = F.flatten(F.transform(kept, lambda t: F.when(simple(t), F.array(t)).otherwise(F.transform(_split_name(t), lambda p: F.lower(p)))))
    own = F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin(fixed.STOP_WORDS))
    aliases = F.flatten(
        F.array(
            *[
                F.when(F.contains(_c(text), F.lit(term)), _words(words)).otherwise(F.array().cast("array<string>"))
                for term, words in fixed.TERM_ALIASES
            ]
        )
    )
    return F.array_distinct(F.concat(own, aliases))


def symbol_tokens(name: Column | str) -> Column:
    parts = _split_name(_c(name))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.lower(p))


def path_hit(path: Column | str, keywords: Column | str) -> Column:
    """First keyword contained in the lower-cased path, else null."""
    low = F.lower(slashes(path))
    return F.try_element_at(F.filter(_c(keywords), lambda k: F.contains(low, k)), F.lit(1))


def symbol_hit(name: Column | str, qualified: Column | str, keywords: Column | str) -> Column:
    """First keyword contained in the name or qualified name, or equal to a name token."""
    low, qual = F.lower(_c(name)), F.lower(F.coalesce(_c(qualified), F.lit("")))
    tokens = symbol_tokens(name)
    return F.try_element_at(
        F.filter(_c(keywords), lambda k: F.contains(low, k) | F.contains(qual, k) | F.array_contains(tokens, k)),
        F.lit(1),
    )


def first_token(name: Column | str) -> Column:
    return F.lower(F.substring_index(_c(name), "_", 1))


def valid_module_token(token: Column | str) -> Column:
    """At least two characters, letters, digits or underscore (any script), no digit first."""
    t = _c(token)
    return F.rlike(t, F.lit(r"^[\p{L}\p{N}_]{2,}$")) & ~F.rlike(t, F.lit(r"^\p{Nd}"))


def has_invalid_token(name: Column | str) -> Column:
    token = first_token(name)
    return (token != "") & ~F.rlike(token, F.lit(r"^[\p{L}\p{N}]+$"))


def classify_module(name: Column | str, first_file: Column | str) -> Column:
    """First layer whose keyword is a substring of the first file path or the name."""
    low_name, low_path = F.lower(_c(name)), F.lower(F.coalesce(slashes(first_file), F.lit("")))
    out = None
    for layer, words in fixed.LAYER_KEYWORDS:
        hit = F.rlike(low_path, F.lit(any_of(words))) | F.rlike(low_name, F.lit(any_of(words)))
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out.otherwise("unknown")


def is_third_party(name: Column | str, first_file: Column | str) -> Column:
    parts = F.split(F.lower(slashes(first_file)), "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.rlike(F.lower(_c(name)), F.lit("^" + any_of(fixed.LIBRARY_PREFIXES))) | F.coalesce(
        F.arrays_overlap(dirs, _words(fixed.LIBRARY_DIRS)), F.lit(False)
    )


def leaf_or_ancestor(path: Column | str) -> Column:
    """Leaf directory, or the nearest ancestor that is not a generic directory; null when there is none."""
    parts = F.split(slashes(path), "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    own = F.filter(dirs, lambda d: ~F.lower(d).isin(fixed.GENERIC_DIRS))
    return F.try_element_at(own, F.lit(-1))


def grounded(text: Column | str, allowed: Column | str) -> Column:
    """No capitalised identifier outside the allow-list; an empty allow-list rejects everything."""
    names = _c(allowed)
    tokens = F.regexp_extract_all(_c(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))
    ok = F.forall(
        tokens,
        lambda t: (t == F.lower(t)) | F.array_contains(names, t) | F.exists(names, lambda a: F.startswith(a, t)),
    )
    return (F.size(names) > 0) & ok


def grounded_prose(text: Column | str, allowed: Column | str) -> Column:
    """As ``grounded`` over upper-cased names, with a prefix relation either way; an empty text is rejected."""
    names = _c(allowed)
    tokens = F.regexp_extract_all(_c(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))

    def fine(t: Column) -> Column:
        up = F.upper(t)
        related = F.exists(names, lambda a: (F.length(a) >= 3) & (F.startswith(a, up) | F.startswith(up, a)))
        return (t == F.lower(t)) | F.array_contains(names, up) | related

    return (_c(text) != "") & F.forall(tokens, fine)


def macro_name(line: Column | str) -> Column:
    return F.regexp_extract(_c(line), r"^\s*#\s*define\s+([A-Za-z_][A-Za-z0-9_]*)", 1)


def macro_body(line: Column | str) -> Column:
    """Text after the macro name (and its parameter list), comments at the end removed."""
    body = F.regexp_extract(
        _c(line), r"^\s*#\s*define\s+[A-Za-z_][A-Za-z0-9_]*(?:\([^)]*\))?(?:\s+(.*))?$", 1
    )
    return F.trim(F.regexp_replace(body, r"\s*(//.*|/\*.*\*/\s*)$", ""))


def macro_kind(line: Column | str) -> Column:
    """``function``, ``flag`` (no body) or ``constant``; null for a line that defines no macro."""
    text = _c(line)
    return (
        F.when(macro_name(text) == "", F.lit(None).cast("string"))
        .when(F.rlike(text, F.lit(r"^\s*#\s*define\s+[A-Za-z_][A-Za-z0-9_]*\(")), "function")
        .when(macro_body(text) == "", "flag")
        .otherwise("constant")
    )


def is_plain_value(body: Column | str) -> Column:
    return F.rlike(_c(body), F.lit(fixed.MACRO_VALUE))
