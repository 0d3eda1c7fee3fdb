"""Registered queries of the training-text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import (
    compression, genetic_packing, host_rules, metric_join, mixing, order_minhash, packing, pii, runs, secrets, shared_search, toxicity, url_lists,
)
from codefacts.llm.common import WORD, table, text_or_empty


def fold(modulus: int) -> Column:
    """Held-out folds of the labelled rows: crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    counts = [_count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base"), pii.KINDS), 256).alias("base_sha256"), _digest(F.col("spans"), pii.KINDS).alias("spans"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicate_classes(table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    counts = [_count(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(_digest(base, secrets.KINDS), 256).alias("base_sha256"), _digest(F.col("spans"), secrets.KINDS).alias("spans"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Captures: every page, fetched on the day that follows from its id. Lists: see ``_entries``."""
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 360).cast("int")).alias("day"))
    return url_lists.judged(captures, _entries(pages)).select("page_id", "url", "day", "host", "rule", "list", "action", "rule_since", "blocked")


def _entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the registered domains of all pages, on days that follow from a hash of the domain.

    Spam list: domains with a telling name are blocked from some day on, allowed for a while and blocked again.
    Abuse list: a quarter of the hosts are blocked for sixty days. Trust list: some subdomains are allowed in midyear.
    """
    hosts = pages.select(url_lists.host_of("url").alias("host")).where("host is not null").distinct()
    day = lambda name, shift: F.date_add(F.lit("2024-01-01").cast("date"), (_hash(name) % 90 + shift).cast("int"))
    entry = lambda df, rule, name, action, shift: df.select(F.col(rule).alias("rule"), F.lit(name).alias("list"), F.lit(action).alias("action"), day(rule, shift).alias("day"))
    domains = hosts.select(F.substring_index("host", ".", -3).alias("domain")).where("domain like '%.example.%'").distinct()
    spam = domains.where(F.col("domain").rlike("pills|spam|casino"))
    abuse = hosts.where(_hash("host") % 4 == 0)
    trust = hosts.where((_hash("host") % 5 == 1) & F.col("host").rlike("^(blog|m)[.]"))
    parts = [
        entry(spam, "domain", "spam", "block", 0), entry(spam, "domain", "spam", "allow", 100), entry(spam, "domain", "spam", "block", 160),
        entry(abuse, "host", "abuse", "block", 60), entry(abuse, "host", "abuse", "allow", 120), entry(trust, "host", "trust", "allow", 150),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hash(name: str) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("long")


def op5_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.linked(table(spark, folder, "embeddings"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return compression.quality(docs, labels, fold(3) != 1).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.toxicity(docs, labels, fold(5) != 0).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op10_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.host_quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = runs.periodic_runs(docs.withColumn("text", _repeating(F.col("doc_id"), text_or_empty())))
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    found = found.withColumn("top", F.aggregate("runs", none, lambda best, r: F.when(longer(best, r), r).otherwise(best)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _repeating(doc_id: Column, text: Column) -> Column:
    """The texts of the query: where h = crc32 of the id ends in 0, the words from a on repeat the first p of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise(F.lit(""))

    once = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), repeated)  # binds the words to a name
    return F.when(h % 10 == 0, F.get(once, F.lit(0))).otherwise(text)


def op12_genetic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return genetic_packing.packed(table(spark, folder, "documents"))


def op13_shared_search(spark: SparkSession, folder: str) -> DataFrame:
    return shared_search.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"))


SPARK = {f.__name__: f for f in (
    op1_pii, op2_near_duplicates, op3_secrets, op4_url_filter, op5_mixture, op6_embedding_links, op7_quality, op8_toxicity, op9_packing, op10_host_rules,
    op11_periodic_runs, op12_genetic_packing, op13_shared_search)}

SQL = {
    "op4_url_filter": r"""
with hosts as (select distinct nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') as host from pages),
known as (select host, cast('0x' || substr(md5(host), 1, 6) as bigint) as h from hosts where host is not null),
domains as (select distinct array_to_string(string_split(host, '.')[-3:], '.') as domain from known),
spam as (select domain, cast('0x' || substr(md5(domain), 1, 6) as bigint) as h from domains where domain like '%.example.%' and regexp_matches(domain, 'pills|spam|casino')),
entries as (
  select domain as rule, 'spam' as list, a.action, date '2024-01-01' + cast(h % 90 + a.shift as integer) as since from spam, (values ('block', 0), ('allow', 100), ('block', 160)) a(action, shift)
  union all select host, 'abuse', a.action, date '2024-01-01' + cast(h % 90 + a.shift as integer) from known, (values ('block', 60), ('allow', 120)) a(action, shift) where h % 4 = 0
  union all select host, 'trust', 'allow', date '2024-01-01' + cast(h % 90 + 150 as integer) from known where h % 5 = 1 and regexp_matches(host, '^(blog|m)[.]')),
spans as (select *, lead(since) over (partition by rule, list order by since) as until from entries),
captures as (select page_id, url, date '2024-01-01' + cast(page_id % 360 as integer) as day,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') as host from pages),
hits as (select c.page_id, s.*, row_number() over (partition by c.page_id order by length(s.rule) desc, s.since desc, (s.action = 'block') desc, s.list) as n
  from captures c join spans s on (c.host = s.rule or ends_with(c.host, '.' || s.rule)) and s.since <= c.day and (s.until is null or c.day < s.until))
select c.page_id, c.url, c.day, c.host, h.rule, h.list, h.action, h.since as rule_since, coalesce(h.action = 'block', false) as blocked
from captures c left join hits h on h.page_id = c.page_id and h.n = 1""",
    "op5_mixture": r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from d group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1.0::double as w, 3.0::double * source_size as lim from totals),
ranked as (select *, lim / w as ratio, (sum(source_size) over () - coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) as lvl from weighed),
numbered as (select *, row_number() over (order by ratio, source nulls last) as pos from ranked),
opened as (select *, (select min(pos) from numbered where lvl < ratio) as o, (select arg_min(lvl, pos) from numbered where lvl < ratio) as level from numbered),
targets as (select source, source_size, case when o is null or pos < o then lim else level * w end as target from opened),
rates as (select *, case when source_size > 0 then round(target / source_size, 9) else 0.0 end as rate from targets),
placed as (select d.doc_id, d.size, r.source_size, r.target, r.rate, cast(row_number() over (partition by d.source order by d.size, d.doc_id % 1024, d.doc_id) as double) as p
  from d join rates r on d.source is not distinct from r.source)
select doc_id, size, source_size, target, cast(least(floor(p * rate) - floor((p - 1) * rate), 3) as bigint) * size as taken from placed""",
    "op6_embedding_links": r"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
pairs as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) as (select vec_id, vec_id from v union select r.x, p.y from reach r join pairs p on r.y = p.x),
n as (select x, count(*) as n_links from pairs group by x),
c as (select x, min(y) as component_id from reach group by x)
select v.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept from v join c on c.x = v.vec_id left join n on n.x = v.vec_id""",
    "op10_host_rules": r"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
tri as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from tri) where n > 1),
rep as (select doc_id, count(distinct i + j) as n from twice, (values (0), (1), (2)) o(j) group by doc_id),
r as (select d.doc_id, d.source, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from d left join rep on rep.doc_id = d.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from r),
h as (select source, count(*)::double as n, sum(base_failed::int)::double as f from f where source is not null group by source),
t as (select sum(f) / sum(n) as m, sum(f * f / n) - sum(f) * sum(f) / sum(n) as between_, count(*) as hosts, sum(n) as total, sum(n * n) as nn from h),
e as (select *, m * (1 - m) as s, (between_ - (hosts - 1) * m * (1 - m)) / (total - nn / total) as x from t),
p as (select m, case when hosts > 1 and x > 0 and s > 0 then greatest(1.0, s / x - 1) else greatest(1.0, total / hosts) end as mass from e),
b as (select source, (h.f + m * mass) as a, (h.n - h.f + (1 - m) * mass) as c from h, p),
bad as (select source from b where a / (a + c) - 2 * sqrt(a / (a + c) * (1 - a / (a + c)) / (a + c + 1)) > 0.8)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (source is null or source not in (select source from bad)) as kept from f""",
    "op13_shared_search": r"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
c as (select count(*)::bigint as docs, sum(len(words))::bigint as total from d where len(words) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
t as (select row, doc_id, n, term, count(*)::bigint as tf from (select row, doc_id, len(words)::bigint as n, unnest(words) as term from d)
  where term in (select term from q) group by row, doc_id, n, term),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from t, c group by term, docs),
s as (select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::bigint as score
  from t join w using (term) join q using (term), c group by item_id, row, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 10""",
}
