"""C facts that follow brackets: nested blocks, signatures over lines, calls in calls, tables, broken and very long texts."""

from __future__ import annotations

import time

import pytest

from codefacts.operators import extract
from codefacts.operators.ctext import Source

TEXT = '''#include "a.h"
#define X { 1
typedef struct tag {
  int a, b; /* { */
  char *name[MAX + 1];
  struct { int q; } inner;
  unsigned bits : 3;
  void (*cb)(int, char *);
} Dev_t;
union U { int i; float f; };
static const struct ops table = {
  .open = my_open,
  .close = &my_close,
  [3] = third,
};
fp_t list[] = { one, &two, { three } };
int proto(int a, char *b);
static int
run(Dev_t *p,
    void (*done)(int),
    int n[])
{
  if (n) { p->a = 1.5; p->inner.q += n; }
  p->cb = on_cb; q->cb = &other; x = y;
  int z = fn;
  register_cb(wrap(first), &second); attach(third, 4); foo(register_x(fourth));
  p->cb(p->a); table[2] = tfn; arr[p->i].h = "a = b; {";
  for (i = k; i < p->n; i++) p->v[i] = w;
  return p->a == 3;
}
extern "C" {
char *name(void) { return 0; }
}
'''


def test_functions():
    got = [(f["name"], f["start_line"], f["end_line"], f["return_type"], f["parameters"], f["definition"]) for f in Source(TEXT).functions]
    assert got == [("proto", 17, 17, "int", ["a", "b"], False), ("run", 18, 30, "static int", ["p", "done", "n"], True), ("name", 32, 32, "char *", [], True)]


def test_members():
    got = [(m["struct"], m["pos"], m["name"], m["type"], m["is_function_pointer"]) for m in Source(TEXT).fields()]
    assert got == [
        ("Dev_t", 0, "a", "int", False), ("Dev_t", 1, "name", "char *[MAX + 1]", False), ("Dev_t", 2, "inner", "struct { int q; }", False), ("Dev_t", 3, "bits", "unsigned", False),
        ("Dev_t", 4, "cb", "void (*)(int, char *)", True), ("U", 0, "i", "int", False), ("U", 1, "f", "float", False)]


def test_bindings():
    got = {(b["line"], b["name"], b["via"], b["field"], b["caller_hint"]) for b in Source(TEXT).bindings()}
    assert got == {
        (12, "my_open", "field_assign", "", None), (13, "my_close", "field_assign", "", None), (14, "third", "field_assign", "", None), (16, "one", "table_assign", "", None),
        (16, "two", "table_assign", "", None), (16, "three", "table_assign", "", None), (24, "on_cb", "field_assign", "cb", "run"), (24, "other", "field_assign", "cb", "run"),
        (24, "y", "var_assign", "", "run"), (26, "second", "register_call", "", "run"), (26, "third", "register_call", "", "run"), (26, "fourth", "register_call", "", "run"),
        (27, "tfn", "table_assign", "", "run"), (28, "k", "var_assign", "", "run"), (28, "w", "table_assign", "", "run")}


def test_usage():
    got = sorted((u["line"], u["field"], u["access"]) for u in Source(TEXT).usage())
    assert got == [
        (23, "a", "write"), (23, "inner", "read"), (23, "q", "write"), (24, "cb", "write"), (24, "cb", "write"), (27, "a", "read"), (27, "cb", "read"), (27, "h", "write"),
        (27, "i", "read"), (28, "n", "read"), (28, "v", "read"), (29, "a", "read")]


@pytest.mark.parametrize("text", ["", "}", "{", "int f(", "int f() {", "/* open", '"open', "struct s {", "a = {", "#define X \\", "f(((", ")])}", "x.y", "é->ü = ß;", "struct { int a; } x;", "1.f = a;"])
def test_broken_texts(text):
    s = Source(text)
    found = [*s.functions, *s.fields(), *s.bindings(), *s.usage()]
    assert all(f.get("name", "x") for f in found)


@pytest.mark.parametrize("text", [
    "int f(int a) { if (a) { p->x = a; } }\n" * 20_000, "word " * 200_000, "{" * 100_000, "a.b" * 100_000, "f(" * 100_000, "t[] = {" + "{a, b}, " * 60_000 + "};",
    "struct s {" + "int a; " * 60_000 + "};", "x = y; " * 60_000, "/*" * 100_000, "a b " * 100_000 + "(c);", "}" * 100_000, "register_a(" + "b, " * 100_000 + ");", "typedef struct { int a; } T;\n" * 20_000])
def test_long_texts_take_linear_time(text):
    took = []
    for part in (text[: len(text) // 4], text):
        start = time.process_time()
        s = Source(part)
        assert len([*s.functions, *s.fields(), *s.bindings(), *s.usage()]) >= 0
        took.append(time.process_time() - start)
    assert took[1] < 8 * max(took[0], 0.2), took


def test_rows_of_files(spark):
    files = spark.createDataFrame([("p", "a.c", TEXT), ("p", "b.c", None), ("p", "c.c", ""), ("q", "a.c", TEXT), ("q", "a.c", TEXT), (None, None, "int g(void) { }")], "project_id string, path string, text string")
    assert extract.extract_functions(files).count() == 3 * 3 + 1
    assert extract.extract_struct_fields(files).count() == 3 * 7 and extract.extract_bindings(files).count() == 3 * 15 and extract.extract_field_usage(files).count() == 3 * 12
    assert extract.extract_functions(files.where("false")).count() == 0
    plan = extract.extract_field_usage(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
