"""Broadcasts by measured size, and joins that leave out rows before a shuffle: same rows as brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codefacts.operators import callgraph, closure, impact, lookups, substrings
from codefacts.plans import questions
from codefacts.projection import Facts

P = "p"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_derived_rows_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    """400 KB of Parquet hold lists of millions of characters; the planner only sees the file."""
    wide = F.concat(F.repeat(F.lit("x"), 200), F.col("p_partkey").cast("string"))
    spark.range(40_000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    part = Facts(spark, str(tmp_path)).table("part")
    a = part.select("p_partkey", wide.alias("name"))
    b = part.select((F.col("p_partkey") + 1).alias("p_partkey"), wide.alias("other"))
    assert "BroadcastHashJoin" in _plan(spark.read.parquet(f"{tmp_path}/part.parquet").select("p_partkey", wide.alias("name")).join(b, "p_partkey").limit(10**9))
    both = a.join(b, "p_partkey")
    assert "BroadcastHashJoin" not in _plan(both)
    assert both.count() == 39_999
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None) != Facts(spark, "").spark.conf.get("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_substring_joins_beyond_the_broadcast_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab_") for _ in range(rng.randint(1, n)))
    texts = sorted({(rng.randint(0, 2), word(40)) for _ in range(80)})
    needles = sorted({(rng.randint(0, 3), word(30)) for _ in range(60)} | {texts[0], (texts[1][0], texts[1][1] + "x")})
    t, n = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(needles, "k int, n string")
    assert rows(substrings.contains_pairs(n, "n", t, "t", ["k"])) == sorted((k, a, b) for k, a in needles for j, b in texts if j == k and a in b)
    first = {(k, a): min(b for j, b in texts if j == k and a in b) for k, a in needles if any(j == k and a in b for j, b in texts)}
    assert rows(substrings.first_containing(n, "n", t, "t", F.col("t"), ["k"])) == sorted((*k, v) for k, v in first.items())
    sym = spark.createDataFrame([(P, i, x, "t", "f") for i, (_, x) in enumerate(texts)], "project_id string, ord int, name string, type string, file string")
    ask = spark.createDataFrame([(P, x) for _, x in needles], "project_id string, ask string")
    want = set()
    for _, a in needles:
        hit = [x for _, x in texts if x != a and (x.endswith(a) or a.endswith(x))]
        if len(a) >= 4 and hit:
            want.add((a, hit[0]))
    assert rows(lookups.weak_symbol_match(ask, sym).select("ask", "name")) == sorted(want)


def test_needles_are_sought_only_with_the_lengths_of_their_key(spark):
    n = spark.createDataFrame([(1, "abc"), (2, "a")], "k int, n string")
    t = spark.createDataFrame([(1, "xxabcabc"), (2, "bab"), (3, "abc")], "k int, t string")
    wanted = n.withColumn("_k", F.col("n"))
    assert rows(substrings._pieces(wanted, t, "t", ["k"])) == sorted([(1, "xxabcabc", x) for x in ("xxa", "xab", "abc", "bca", "cab")] + [(2, "bab", "a"), (2, "bab", "b")])


def test_edges_of_questions_equal_every_call_compared(spark):
    rng = random.Random(6)
    names = [f"n{i}_{w}" for i, w in enumerate(["read", "write", "open", "read", "draw", "send"])]
    calls = [(P, "f.c", rng.randint(1, 2), rng.choice(names), rng.choice([*names, None]), rng.choice(["high", None])) for _ in range(60)]
    asked = [(P, 1, "read_draw"), (P, 2, "write"), (P, 3, "absent_word"), (P, 4, "draw")]
    sym = spark.createDataFrame([(P, i, x, x, "function", "f.c") for i, x in enumerate(names)], "project_id string, ord int, name string, qualified_name string, type string, file string")
    files = spark.createDataFrame([(P, "f.c", 1, "compiled")], "project_id string, path string, ord int, compile_status string")
    c = spark.createDataFrame(calls, "project_id string, file string, line int, caller string, callee string, confidence string")
    inc = spark.createDataFrame([], "project_id string, src string, target string")
    a = questions.Answers(spark.createDataFrame(asked, "project_id string, query_id bigint, text string"), sym, files, c, inc)
    want = {}
    for _, q, text in asked:
        hit = {x for x in names if any(w in x for w in text.split("_"))}
        for _, f, line, x, y, conf in calls:
            if x in hit or y in hit:
                k = (q, f, line, x, y, conf)
                want[k] = (want.get(k, (0,))[0] + 1, int(x in hit), int(y in hit))
    got = a.edges.select("query_id", "file", "line", "caller", "callee", "confidence", "n", "hit_caller", "hit_callee").collect()
    assert len(got) == len(want) and {tuple(r)[:6]: tuple(r)[6:] for r in got} == want
    flow = {}
    for q, f, line, x, y, _ in want:
        for side, end in enumerate((x, y)):
            flow[q, end] = min(flow.get((q, end), (f, line, x, y or "~", side)), (f, line, x, y or "~", side))
    for _, q, text in asked:
        for x in names:
            if any(w in x for w in text.split("_")):
                flow.setdefault((q, x), None)
    got = questions.linear_flow(a).select("query_id", "symbol", "step", "file", "line", "caller", F.coalesce("callee", F.lit("~")), "side").collect()
    known = [tuple(r) for r in got if r["symbol"] is not None]
    assert {(r[0], r[1]): tuple(r[3:]) if r[2] == 0 else None for r in known} == {k: v for k, v in flow.items() if k[1]} and len(known) == len({r[:2] for r in known})
    hits = {q: {x for x in names if any(w in x for w in text.split("_"))} for _, q, text in asked}
    assert rows(a.far_names().where("name is not null").select("query_id", "name")) == sorted({(q, e) for q, e in flow if e and e not in hits[q]})


def test_a_bit_table_holds_many_words_a_row(spark):
    keys = spark.range(40_000)
    table = substrings.bit_table(keys, ["id"], 10)
    assert table.count() == 2**10 // substrings.SLOTS
    some = substrings.bit_table(keys.where("id % 100 = 0"), ["id"], 14)
    marked = substrings.mark_maybe(keys, some, ["id"], 14).groupBy((F.col("id") % 100 == 0).alias("k")).agg(F.count_if("_maybe").alias("n"), F.count("*").alias("m"))
    by = {r["k"]: r for r in marked.collect()}
    assert by[True]["n"] == by[True]["m"] == 400 and by[False]["n"] < 100 and by[False]["m"] == 39_600


def test_sets_go_over_hubs_as_bits(spark):
    rng = random.Random(7)
    has = sorted({(P, f"S:m{rng.randint(0, 150):03d}", f"h{rng.randint(0, 40)}") for _ in range(900)})
    out = sorted({(P, f"h{rng.randint(0, 45)}", f"f{rng.randint(0, 30)}") for _ in range(200)})
    got = impact.over_hubs(spark.createDataFrame(has, "project_id string, set string, hub string"), spark.createDataFrame(out, "project_id string, hub string, dst string"))
    assert rows(got.select("set", "dst")) == sorted({(s, d) for _, s, h in has for _, k, d in out if h == k})
    met = spark.createDataFrame([(P, f"S:m{i}", "h") for i in range(64)], "project_id string, set string, hub string")
    many = spark.range(1000).select(F.lit(P).alias("project_id"), F.lit("h").alias("hub"), F.concat(F.lit("f"), "id").alias("dst"))
    assert impact.over_hubs(met, many).count() == 64_000


def test_callbacks_are_distinct_without_a_shuffle_of_the_pairs(spark):
    fields = spark.createDataFrame([(P, s, "f", "d/a.h") for s in ("s1", "s1", "s2")], "project_id string, struct string, field string, file string")
    bound = spark.createDataFrame([(P, x, "field_assign", "e/a.c", line, "f") for x in ("g", "h") for line in (1, 2)], "project_id string, callee string, via string, file string, line int, field string")
    got = callgraph.registered_callbacks(fields, bound)
    assert rows(got.select("struct", "registered")) == [("s1", "g"), ("s1", "h"), ("s2", "g"), ("s2", "h")]
    top = got._jdf.queryExecution().optimizedPlan().toString()
    assert top.index("Join") < top.index("Aggregate")


def test_reach_makes_its_last_step_distinct_once(spark):
    e = spark.createDataFrame([(P, a, b) for a, b in [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)]], "project_id string, src int, dst int")
    got = closure.reach_fixed(spark.createDataFrame([(P, 9, 1)], "project_id string, start int, node int"), e, ["project_id"], 2)
    assert rows(got.select("node")) == [(1,), (2,), (3,), (4,)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") < 7


def test_reach_lists_the_last_step_only_beside_its_start(spark):
    e = [(P, a, b) for a in range(30) for b in range(100, 130)] + [(P, a, b) for a in range(100, 130) for b in (*range(200, 260), None)] + [(P, None, 7)]
    edges = spark.createDataFrame(e, "project_id string, src int, dst int")
    got = closure.reach_fixed(spark.createDataFrame([(P, a, a) for a in (*range(30), None)], "project_id string, start int, node int"), edges, ["project_id"], 2)
    assert {tuple(r) for r in got.groupBy("start").count().collect()} == {(a, 1 + 30 + 61) for a in range(30)} | {(None, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")  # printed from the top: the lists are opened after the last shuffle
    names = spark.createDataFrame([(P, x) for x in ["a", "b", "a", None, "c"]] + [("q", "a")], "project_id string, name string")
    number = closure.numbered(names, ["project_id"], "name").collect()
    assert sorted(r["number"] for r in number) == [0, 1, 2, 3] and {r[:2] for r in number} == {(P, "a"), (P, "b"), (P, "c"), ("q", "a")}


def test_an_impact_search_carries_its_starts_as_bits(spark):
    none = lambda schema: spark.createDataFrame([], "project_id string, " + schema)
    files = [f"f{i}.h" for i in range(70)]
    inc = spark.createDataFrame([(P, a, b) for a in files for b in files if a != b], "project_id string, src string, target string")
    sym = spark.createDataFrame([(P, "x", "f1.h"), (P, "y", "f2.h")], "project_id string, name string, file string")
    mods = spark.createDataFrame([(P, "M", "x"), (P, "N", "y")], "project_id string, module string, name string")
    deps = spark.createDataFrame([(P, "M", "N")], "project_id string, `from` string, `to` string")
    usage = spark.createDataFrame([(P, "v", "x", "write"), (P, "v", "y", "read")], "project_id string, field string, function string, access string")
    g = impact.impact_graph(sym, none("caller string, callee string"), none("callee string, file string, caller_hint string"), none("struct string, field string, file string"), usage, inc, mods, deps)
    starts = spark.createDataFrame([(P, f, f"F:{f}") for f in files] + [(P, "x", "x"), (P, None, "y")], "project_id string, start string, node string")
    got = impact.reach(g, starts, 2)
    assert got.columns == ["project_id", "start", "node"] and "module_deps" in g.__dict__ and "set_out" not in g.__dict__
    want = {(f, f"F:{n}") for f in files for n in files}
    want |= {("x", n) for n in ("x", "y", "F:f1.h", "F:f2.h", "S:M", *[f"F:{f}" for f in files])} | {(None, n) for n in ("y", "F:f2.h", "S:M", "O:M", *[f"F:{f}" for f in files])}
    assert {tuple(r) for r in got.select("start", "node").collect()} == want and got.count() == len(want)
