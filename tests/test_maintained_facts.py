"""Facts kept by a stream of changes: deletions, late changes, two streams, broken batches, untouched shards."""

from __future__ import annotations

from pathlib import Path

import pytest

from codefacts.plans import refresh
from codefacts.sources import store
from codefacts.streaming import maintain

P = "p"
SCHEMA = "project_id string, path string, op string, text string, seq bigint"


def code(n):
    return f"#define N {n}\nstruct s {{ int a; }};\nint run(int a) {{\n  p->x = a;\n}}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_as_full_build(spark, root, texts):
    status, tables = store.read_index(spark, root)
    assert status == "VALID"
    full = refresh.extract_facts(spark.createDataFrame([(p, path, t) for (p, path), t in texts.items()], "project_id string, path string, text string"))
    for name in maintain.TABLES:
        assert rows(tables[name].select(*full[name].columns)) == rows(full[name]), name


def part_files(root, table):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in Path(root, "facts", table).rglob("part-*")}


def test_changes_in_any_order_and_deletions(spark, tmp_path):
    root = str(tmp_path / "idx")
    a = [(P, f"f{i}.c", "upsert", code(i), 10) for i in range(12)] + [("q", "f1.c", "upsert", code(99), 10)]
    assert maintain.apply_changes(spark.createDataFrame(a, SCHEMA), root, "s1", 0, shards=8)
    before = {t: part_files(root, t) for t in ("files", "macros")}
    b = [(P, "f1.c", "delete", None, 11), (P, "f2.c", "upsert", code(200), 12), (P, "f2.c", "upsert", code(5), 11), (P, "f3.c", "upsert", "old", 9), (None, "x.c", "upsert", "x", 1), (P, None, "upsert", "x", 1)]
    assert maintain.apply_changes(spark.createDataFrame(b, SCHEMA), root, "s1", 1, shards=8)
    texts = {(p, f): t for p, f, _, t, _ in a} | {(P, "f2.c"): code(200)}
    del texts[P, "f1.c"]
    same_as_full_build(spark, root, texts)
    for t, files in before.items():  # f1 and f2 lie in two shards at most, all others keep their files
        now = part_files(root, t)
        changed = {str(f).split("shard=")[1].split("/")[0] for f in files if files[f] != now.get(f)}
        assert 1 <= len(changed) <= 2, t
    # a change older than the deletion comes late, a batch comes again, another stream starts at 0
    assert maintain.apply_changes(spark.createDataFrame([(P, "f1.c", "upsert", code(7), 10)], SCHEMA), root, "s1", 2, shards=8)
    assert not maintain.apply_changes(spark.createDataFrame([(P, "f5.c", "delete", None, 50)], SCHEMA), root, "s1", 2, shards=8)
    same_as_full_build(spark, root, texts)
    assert maintain.apply_changes(spark.createDataFrame([(P, "f1.c", "upsert", code(8), 13)], SCHEMA), root, "s2", 0, shards=8)
    same_as_full_build(spark, root, texts | {(P, "f1.c"): code(8)})
    gone = [(p, f, "delete", None, 99) for p, f in texts | {(P, "f1.c"): 0}]
    assert maintain.apply_changes(spark.createDataFrame(gone, SCHEMA), root, "s2", 1, large_change=3, shards=8)
    status, tables = store.read_index(spark, root)
    assert status == "VALID" and all(tables[t].count() == 0 for t in maintain.TABLES)
    assert rows(tables["set_aside"]) == [(P, 12, "REINDEX_REQUIRED")]


def test_broken_batch_is_applied_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "idx")
    first = spark.createDataFrame([(P, f"f{i}.c", "upsert", code(i), 1) for i in range(6)], SCHEMA)
    maintain.apply_changes(first, root, "s", 0, shards=4)
    second = spark.createDataFrame([(P, "f0.c", "delete", None, 2), (P, "f1.c", "upsert", code(100), 2)], SCHEMA)
    whole = store.replace_shards
    for broken in ("macros", "files", "applied", None):  # the run breaks off before that table, or before the commit
        def stop(df, path, touched, at=broken):
            if at and path.endswith(f"/{at}"):
                raise OSError("lost")
            whole(df, path, touched)

        def lost(*args, **kwargs):
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(store, "replace_shards", stop)
            m.setattr(store, "commit", lost)
            with pytest.raises(OSError, match="lost"):
                maintain.apply_changes(second, root, "s", 1, shards=4)
    assert maintain.apply_changes(second, root, "s", 1, shards=4)
    texts = {(P, f"f{i}.c"): code(i) for i in range(1, 6)} | {(P, "f1.c"): code(100)}
    same_as_full_build(spark, root, texts)


def test_changes_without_seq(spark, tmp_path):
    root = str(tmp_path / "idx")
    plain = "project_id string, path string, text string"
    maintain.apply_changes(spark.createDataFrame([(P, "a.c", code(1)), (P, "a.c", code(1))], plain), root, "s", 0)
    maintain.apply_changes(spark.createDataFrame([(P, "a.c", code(2))], plain), root, "s", 1)
    same_as_full_build(spark, root, {(P, "a.c"): code(2)})
    with pytest.raises(Exception, match="several changes without seq"):
        maintain.apply_changes(spark.createDataFrame([(P, "a.c", code(3)), (P, "a.c", code(4))], plain), root, "s", 2)
    assert maintain.apply_changes(spark.createDataFrame([], plain), root, "s", 3)
    same_as_full_build(spark, root, {(P, "a.c"): code(2)})
