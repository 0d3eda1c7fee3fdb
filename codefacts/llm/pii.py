"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Looser patterns add candidates (written-out
e-mail addresses, IPv6, national phone numbers, shorter card numbers). On every candidate five labelers vote yes, no or
nothing: the base pattern, a check (Luhn, number ranges), a gazetteer (domains, issuers, calling codes), the words before
the span, and its borders. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is for each kind; a logistic span classifier is then trained on the posteriors. Base spans always stay; the classifier
decides on the candidates.

The model is fitted on counts per (kind, votes, length class) over all documents: at most 4 * 3^5 * 4 = 3,888 rows reach
the driver, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import running_sums, text_or_empty
from codefacts.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5

# Possessive forms and the look-behinds give the same leftmost matches as the plain patterns, without backtracking.
BASE = {
    "email": (r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": (r"[\[(](?i:at)[\])]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?i:dot)[\])]|\.)\x20?[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9A-Za-z+-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9A-Za-z-])"),
    "phone": (r"[0-9][.\x20-][0-9]{4}", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])"),
}
# Gazetteers, as patterns over the span.
GAZETTEER = {
    "email": r"(?i)[.\x20](?:com|org|net|edu|gov|mil|int|info|io|de|fr|es|it|uk|nl|eu|ch|at|us|ca)$",
    "ip": r"^(?:10|127|172|192)\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-69]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9]",
}
# Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)[^A-Za-z]{0,4}\w{0,3}[^A-Za-z]{0,3}$",
    "ip": r"(?i)(?:\bip|host|server|address|from|client|login)[^A-Za-z]{0,4}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|pay)[^A-Za-z]{0,6}\w{0,6}[^A-Za-z]{0,3}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|telefon|contact)[^A-Za-z]{0,4}\w{0,3}[^A-Za-z]{0,3}$",
}
AGAINST = r"(?i)(?:version|release|order|invoice|isbn|issn|serial|sku|part|ref|id|token|hash|section|rfc)[^A-Za-z]{0,4}$"


def _located(docs: DataFrame, patterns: dict[str, tuple[str, str]], prefix: str) -> DataFrame:
    """Adds for each kind ``<prefix>_<kind>``: spans (start, end, value) in code points of ``_text``.

    Matches and the gaps between them come from the same sequence of finds; positions are their running lengths.
    """
    for kind, (guard, pattern) in patterns.items():
        has = F.col("_text").rlike(guard)
        docs = docs.withColumn("_h", F.when(has, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn("_g", F.when(F.size("_h") > 0, F.slice(F.split("_text", pattern, -1), F.lit(1), F.size("_h"))).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn("_b", running_sums(F.zip_with("_h", "_g", lambda h, g: (F.length(h) + F.length(g)).cast("long"))))
        docs = docs.withColumn(f"{prefix}_{kind}", F.transform(
            F.arrays_zip(F.col("_h").alias("h"), F.col("_g").alias("g"), F.col("_b").alias("b")),
            lambda x: F.struct((x["b"] + F.length(x["g"])).alias("start"), (x["b"] + F.length(x["g"]) + F.length(x["h"])).alias("end"), x["h"].alias("value")),
        )).drop("_h", "_g", "_b")
    return docs


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    back = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    parts = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.regexp_replace(p, "^0+(?=.)", "").cast("decimal(38,0)") <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    return F.length(digits).between(8, 15)


def _check(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.length(value) <= 254
    if kind == "ip":
        return ~value.rlike(r"^0|^(?:22[4-9]|2[3-5][0-9])\.")
    if kind == "card":
        return _luhn(_digits(value))
    return ~_digits(value).rlike(r"^(.)\1*$")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 2).otherwise(0)


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``_text``, ``_base`` (spans of the base patterns) and ``_more`` (other candidates), each with its votes.

    A null text counts as empty. Spans have ``kind`` (position in KINDS), ``start``, ``end``, ``size`` and ``votes``.
    """
    docs = _located(_located(docs.withColumn("_text", text_or_empty()), BASE, "_base"), LOOSE, "_more")

    def judged(kind: str, base: bool):
        k = KINDS.index(kind)

        def one(x: Column) -> Column:
            value, at = x["value"], x["start"].cast("int")
            before = F.substring(F.col("_text"), F.greatest(at - 39, F.lit(1)), F.least(at, F.lit(40)))
            after = F.substring(F.col("_text"), x["end"].cast("int") + 1, F.lit(1))
            votes = [
                F.lit(1 if base else 2),
                _vote(_check(kind, value), F.lit(True)),
                _vote(value.rlike(GAZETTEER[kind]), F.lit(kind in ("email", "card"))),
                _vote(before.rlike(FOR[kind]), before.rlike(AGAINST)),
                _vote(~before.rlike(r"[A-Za-z0-9]$") & ~after.rlike(r"[A-Za-z0-9]"), F.lit(True)),
            ]
            length = F.length(value)
            size = F.when(length < 12, 0).when(length < 18, 1).when(length < 26, 2).otherwise(3)
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), size.alias("size"), F.array(*votes).alias("votes"))

        return one

    def checked(kind: str):
        return lambda x: _valid(kind, x["value"])

    base = F.concat(*[F.transform(F.filter(f"_base_{k}", checked(k)), judged(k, True)) for k in KINDS])
    more = F.concat(*[F.transform(f"_more_{k}", judged(k, False)) for k in KINDS])
    docs = docs.withColumn("_base", base).withColumn("_all", more)
    free = F.filter("_all", lambda x: ~F.exists(F.col("_base"), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return docs.withColumn("_more", free).drop("_all", *[f"{p}_{k}" for p in ("_base", "_more") for k in KINDS])


def fit(candidates: DataFrame, rounds: int = 25, steps: int = 200) -> list[float]:
    """Weights of the span classifier from ``_base`` and ``_more`` of all rows; zeros where there are no candidates."""
    span = F.explode(F.concat("_base", "_more")).alias("s")
    counts = candidates.select(span).groupBy("s.kind", "s.size", "s.votes").agg(F.count("*").alias("n")).orderBy("kind", "size", "votes").collect()
    rows = [(r["kind"], r["size"], list(r["votes"]), r["n"]) for r in counts]
    spread = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    belief = [spread(1.5 * sum({0: 0, 1: 1, 2: -1}[v] for v in votes)) for _, _, votes, _ in rows]
    for _ in range(rounds):  # how often each labeler casts each vote on true and on false spans, then the posteriors again
        prior = [[1.0, 1.0] for _ in KINDS]
        cast = [[[[1.0] * 3 for _ in range(2)] for _ in range(LABELERS)] for _ in KINDS]
        for (k, _, votes, n), p in zip(rows, belief, strict=True):
            for c, share in ((0, 1 - p), (1, p)):
                prior[k][c] += n * share
                for j, v in enumerate(votes):
                    cast[k][j][c][v] += n * share
        belief = []
        for k, _, votes, _ in rows:
            odds = math.log(prior[k][1] / prior[k][0])
            for j, v in enumerate(votes):
                yes, no = cast[k][j][1], cast[k][j][0]
                odds += math.log(yes[v] / sum(yes)) - math.log(no[v] / sum(no))
            belief.append(spread(odds))
    weights = [0.0] * (len(KINDS) + 4 + 3 * LABELERS)
    total = sum(n for *_, n in rows) or 1
    for _ in range(steps):
        slope = [0.0] * len(weights)
        for (k, size, votes, n), p in zip(rows, belief, strict=True):
            on = _features(k, size, votes)
            miss = (spread(sum(weights[i] for i in on)) - p) * n / total
            for i in on:
                slope[i] += miss
        weights = [w - 1.5 * (g + 1e-4 * w) for w, g in zip(weights, slope, strict=True)]
    return weights


def _features(kind: int, size: int, votes: list[int]) -> list[int]:
    return [kind, len(KINDS) + size, *[len(KINDS) + 4 + 3 * j + v for j, v in enumerate(votes)]]


def _accepted(x: Column, weights: list[float]) -> Column:
    table = F.array(*[F.lit(float(w)) for w in weights])
    score = F.get(table, x["kind"]) + F.get(table, x["size"] + len(KINDS))
    for j in range(LABELERS):
        score = score + F.get(table, F.get(x["votes"], j) + len(KINDS) + 4 + 3 * j)
    return score >= 0


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of (kind, start, end) by kind and start, one row per row of ``docs``.

    ``spans`` holds the base spans and the candidates that the classifier accepts. A null text is empty and has no
    spans; repeated rows are scanned alike; other columns are ignored; the empty table gives no rows.
    """
    found = cut_lineage(with_candidates(docs.select("doc_id", "text")).select("doc_id", "_base", "_more"))
    weights = fit(found)
    accepted = F.filter("_more", lambda x: _accepted(x, weights))
    return found.select("doc_id", _ordered(F.col("_base")).alias("base"), _ordered(F.concat("_base", accepted)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets and ``n_chars`` counted anew.

    Overlapping spans become one replacement, named after the first. A null text stays null. Columns and rows stay.
    """
    found = with_candidates(docs)
    weights = fit(cut_lineage(found.select("_base", "_more")))
    spans = F.array_sort(F.transform(
        F.concat("_base", F.filter("_more", lambda x: _accepted(x, weights))),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
    ))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    found = found.withColumn("_spans", spans)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(F.col("_text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.get(names, x["kind"]))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    found = found.withColumn("_done", F.aggregate("_spans", start, step))
    tail = F.expr("substring(_text, cast(_done.at + 1 as int))")
    text = F.when(F.col("text").isNull() | (F.size("_spans") == 0), F.col("text")).otherwise(F.concat(F.array_join("_done.out", ""), tail))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
