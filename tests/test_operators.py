"""Operators against plain-Python renderings of their rules, on random and hand-written input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from codefacts.functions import paths, records, words
from codefacts.operators import changes, closure, impact, modules, scope, substrings, timeline
from codefacts.operators.scan import row_numbers, running_sum

P = "p"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_sum_is_bucket_free(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, seq bigint, v bigint")
    got = {(r.k, r.seq): r.s for r in running_sum(df, ["k"], F.floor(F.col("seq") / 7), ["seq"], F.col("v"), "s").collect()}
    total: dict[str, int] = {}
    for k, i, v in data:
        total[k] = total.get(k, 0) + v
        assert got[k, i] == total[k]
    assert {r.n for r in row_numbers(df.where("k = 'b'"), ["k"], F.floor(F.col("seq") / 7), ["seq"], "n").collect()} == set(range(1, sum(k == "b" for k, *_ in data) + 1))


def test_tool_pairs_equal_a_queue(spark):
    rng = random.Random(2)
    data = [(P, rng.choice([1, 1, 1, 2]), i, None, rng.choice(["ToolStarted", "ToolFinished", "Other"]), "{}") for i in range(600)]
    df = spark.createDataFrame(data, "project_id string, task_id bigint, seq bigint, ts timestamp, type string, payload string")
    want, queue = [], {}
    for _, task, seq, _, kind, _ in data:
        if kind == "ToolStarted":
            queue.setdefault(task, []).append(seq)
        elif kind == "ToolFinished" and queue.get(task):
            want.append((task, queue[task].pop(0), seq))
    for block in (5, 1000):
        assert rows(timeline.pair_tool_events(df, block).select("task_id", "start_seq", "end_seq")) == sorted(want)


def test_contains_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab_") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    needles = ["".join(rng.choice("ab_") for _ in range(rng.randint(1, 30))) for _ in range(40)] + [texts[0], texts[1] + "x"]
    t = spark.createDataFrame([(P, x) for x in texts], "project_id string, t string")
    n = spark.createDataFrame([(P, x) for x in needles], "project_id string, n string")
    want = sorted({(P, a, b) for a in needles for b in texts if a in b})
    assert rows(substrings.contains_pairs(n, "n", t, "t", ["project_id"])) == want


def _closure(starts, edges):
    seen = set(starts)
    todo = list(starts)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_closure_with_cycles(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)]
    e = spark.createDataFrame([(P, str(a), str(b)) for a, b in edges], "project_id string, src string, dst string")
    s = spark.createDataFrame([(P, "1"), (P, "2")], "project_id string, node string")
    got = {r.node for r in closure.closure(s, e, ["project_id"]).collect()}
    assert got == {str(x) for x in _closure([1, 2], edges)}


def test_header_affected_and_boundary(spark):
    files = ["a/x.h", "a/y.h", "a/m.c", "b/n.c", "b/z.h", "a/m.h"]
    f = spark.createDataFrame([(P, x, i) for i, x in enumerate(files)], "project_id string, path string, ord bigint")
    inc = spark.createDataFrame([(P, "a/m.c", "x.h"), (P, "a/x.h", "y.h"), (P, "b/n.c", "z.h"), (P, "b/z.h", "a/m.c")], "project_id string, src string, target string")
    h = spark.createDataFrame([(P, "a/y.h")], "project_id string, path string")
    assert {r.path for r in changes.header_affected(h, inc, f).collect()} == {"a/y.h", "a/x.h", "a/m.c", "b/z.h", "b/n.c"}
    compiled = spark.createDataFrame([(P, "a/m.c")], "project_id string, path string")
    inc2 = spark.createDataFrame([(P, "a/m.h", "a/x.h"), (P, "a/x.h", "a/m.h"), (P, "a/x.h", "gone.h")], "project_id string, src string, target string")
    assert {r.path for r in scope.build_boundary(compiled, inc2, f.select("project_id", "path")).collect()} == {"a/m.c", "a/m.h", "a/x.h"}


def test_impact_links_equal_explicit_graph(spark):
    rng = random.Random(5)
    names = [f"s{i}" for i in range(14)]
    module = {n: f"m{i % 4}" for i, n in enumerate(names)}
    calls = {(rng.choice(names), rng.choice(names)) for _ in range(8)}
    usage = {(f"f{rng.randint(0, 3)}", rng.choice(names), rng.choice(["read", "write"])) for _ in range(8)}
    deps = {("m1", "m0")}
    df = lambda data, schema: spark.createDataFrame([(P, *r) for r in data] or [], "project_id string, " + schema)
    sym = df([(n, f"src/{n}.c") for n in names], "name string, file string")
    g = impact.impact_graph(
        sym, df(calls, "caller string, callee string"), df([], "callee string, file string, caller_hint string"), df([], "struct string, field string, file string"),
        df(usage, "field string, function string, access string"), df([], "src string, target string"), df([(module[n], n) for n in names], "module string, name string"), df([("m1", "m0")], "`from` string, `to` string"))
    edges = {(n, f"F:src/{n}.c") for n in names} | {(b, a) for a, b in calls} | {(fl, fn) for fl, fn, _ in usage}
    for fl, w, acc in usage:
        edges |= {(w, r) for f2, r, a2 in usage if f2 == fl and acc == "write" and a2 == "read"}
    for frm, to in deps:
        edges |= {(d, c) for d in names if module[d] == to for c in names if module[c] == frm}

    def two(x):
        one = {b for a, b in edges if a == x} | {x}
        return one | {b for a, b in edges if a in one}

    want = sorted({(P, "g", a, b) for a in names for b in names if a != b and (b in two(a) or a in two(b))})
    anchors = df([("g", n, n) for n in names], "grp string, item string, node string")
    assert rows(impact.linked_anchors(g, anchors, "grp", "item")) == want


def test_discover_modules(spark):
    files = [("App/ui_shelf.c", "project"), ("App/ui_shelf.h", "project"), ("KEY/key.c", "project"), ("KEY/key.h", "project"), ("GPIO/gpio.c", "project"),
             ("main.c", "project"), ("Middlewares/LVGL/lv_obj.c", "third_party"), ("old/tool.c", "non_build"), ("grp/any.c", "project")]
    f = spark.createDataFrame([(P, p, i, s, "LVGL" if s == "third_party" else None) for i, (p, s) in enumerate(files)], "project_id string, path string, ord bigint, scope_type string, scope_name string")
    syms = [("ui_shelf_refresh", "App/ui_shelf.c"), ("ui_shelf_input", "App/ui_shelf.c"), ("key_init", "KEY/key.c"), ("key_scan", "KEY/key.c"), ("gpio_init", "GPIO/gpio.c"), ("key_read", "GPIO/gpio.c"),
            ("main", "main.c"), ("lv_obj_create", "Middlewares/LVGL/lv_obj.c"), ("any", "grp/any.c")]
    s = spark.createDataFrame([(P, i, n, p) for i, (n, p) in enumerate(syms)], "project_id string, ord bigint, name string, file string")
    g = spark.createDataFrame([(P, "grp/any.c", "Drivers")], "project_id string, path string, `group` string")
    c = spark.createDataFrame([(P, "main", "key_init", "main.c", "high")], "project_id string, caller string, callee string, file string, confidence string")
    inc = spark.createDataFrame([(P, "main.c", "KEY/key.h")], "project_id string, src string, target string")
    d = modules.discover_modules(f, s, g, c, inc)
    mods = {r.name: r for r in d.modules.collect()}
    home = {(r.module, r.path) for r in d.files.collect()}
    own = {(r.module, r.name) for r in d.symbols.collect()}
    assert {p for _, p in home} == {p for p, _ in files}  # no file is lost
    assert ("KEY", "KEY/key.h") in home and ("KEY", "key_read") in own and ("KEY", "GPIO/gpio.c") in home  # key_read moved with its file
    assert ("UI", "App/ui_shelf.c") in home and ("UI", "App/ui_shelf.h") in home
    assert mods["LVGL"].third_party and mods["LVGL"].confidence == 0.9 and mods["LVGL"].basis.startswith("scope_config:LVGL")
    assert mods["old (non-build)"].confidence == 0.7
    assert mods["Drivers"].confidence == 0.95 and mods["Drivers"].basis == "keil_group:Drivers"
    assert mods["KEY"].confidence == 0.85 and "prefix:key" in mods["KEY"].basis


def test_scope_and_ignore_rules(spark):
    cases = [("User/tool.py", "*.py", True), ("User/tool.py", "*.py/**", True), ("LT/a.c", "LT", True), ("LTX/a.c", "LT", False), ("a/b/c.c", "a/*", True), ("x/docs/a", "docs/**", False), ("docs/a", "docs/**", True),
             ("a[1].c", "a[[]1].c", True), ("abc", "a?c", True), ("x", "", False)]
    df = spark.createDataFrame(cases, "path string, pat string, want boolean")
    assert [r for r in df.select("path", "pat", "want", paths.ignore_match("path", "pat").alias("got")).collect() if r.got != r.want] == []


def test_words_and_records(spark):
    one = spark.createDataFrame([("LCD初始化并修复 param_init 的 bug, key key_ScanTask and the module",)], "t string")
    assert one.select(words.extract_keywords("t")).first()[0] == ["lcd", "param", "init", "bug", "key", "scan task"]
    assert one.select(records.structured_payload(F.lit('x {"findings": [1]} y'))).first()[0] == "finding"
    assert one.select(records.structured_payload(F.lit("x {bad} y"))).first()[0] is None
    df = spark.createDataFrame([("uses Storage", ["Store"]), ("uses Sto here", ["Store"]), ("plain words", []), ("plain words", ["A"])], "t string, a array<string>")
    assert [r[0] for r in df.select(words.grounded("t", "a")).collect()] == [False, True, False, True]


def test_every_file_counts_in_a_fingerprint(spark):
    from codefacts.operators import hashes

    rows = [("p", f"f{i:05d}.c", "x") for i in range(2001)]
    base = hashes.fingerprint(spark.createDataFrame(rows, "project_id string, path string, text string")).first()
    last = hashes.fingerprint(spark.createDataFrame([*rows[:-1], ("p", rows[-1][1], "y")], "project_id string, path string, text string")).first()
    assert base["fingerprint"] != last["fingerprint"]


def test_calls_are_read_once_for_entries_and_links(spark):
    from codefacts.operators import relations

    make = lambda data, schema: spark.createDataFrame([(P, *r) for r in data], "project_id string, " + schema)
    calls = make([("a", "b", "x.c", "high"), ("a", "b", "y.c", "low"), (None, "b", "x.c", "high"), ("lost", "b", "y.h", None), ("lost", "c", "none.c", "high"), ("c", "b", "y.h", "high"), ("b", None, "x.c", "low"), ("bare", "a", "y.h", "low")],
                 "caller string, callee string, file string, confidence string")
    own = make([("M", "a", 1), ("N", "b", 2), ("N", "b", 3), ("N", "c", 4), (None, "bare", 5)], "module string, name string, ord bigint")
    files = make([("X", "x.c"), ("Y", "y.h"), (None, "none.c")], "module string, path string")
    links = relations._call_links(calls, own, files)
    got = links.groupBy("m1", "m2", "callee").agg(F.sum("n").alias("n"), F.sum("n_high").alias("h"))
    assert sorted(tuple(r) for r in got.collect()) == [("M", "N", "b", 2, 1), ("N", "N", "b", 1, 1), ("X", "N", "b", 1, 1), ("Y", "M", "a", 1, 0), ("Y", "N", "b", 1, 0)]
    known = links._jdf.queryExecution().analyzed().toString()
    assert known.index("Union") < known.index("Aggregate")  # counted by module before the names of callees are joined
    entries = relations.entry_points(calls, own)
    assert sorted(tuple(r) for r in entries.select("module", "name", "ord", "outside_calls", "rank").collect()) == [("M", "a", 1, 1, 1), ("N", "b", 2, 4, 1), ("N", "b", 3, 4, 2)]
    assert "LeftSemi" not in entries._jdf.queryExecution().analyzed().toString() and entries._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
