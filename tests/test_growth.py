"""Steps whose cost must follow the rows: one parse of a file, a fixed number of batches, partitions by input size."""

from pyspark.sql import functions as F

from codefacts.catalog import streams
from codefacts.operators import extract
from codefacts.plans import refresh, relations_refresh
from codefacts.session import cut_lineage, fine_shuffles, measured_session, scratch_folder

TEXT = "typedef struct {\n  int a;\n  void (*cb)(int);\n} S;\nint run(S *p) {\n  p->a = 1;\n  p->cb = on_x;\n  return p->a;\n}\n"


def test_one_pass_finds_what_four_found(spark):
    files = spark.createDataFrame([("p", "a.c", TEXT), ("p", "b.c", TEXT), ("p", "none.c", None), ("p", "empty.c", "")], "project_id string, path string, text string")
    seen = cut_lineage(extract.bracket_facts(extract.size_guard(files)[0]))
    once, apart = refresh.extract_facts(files, seen=seen), refresh.extract_facts(files)
    for kind in extract.BRACKETS:
        assert once[kind].schema.names == apart[kind].schema.names
        assert sorted(map(str, once[kind].collect())) == sorted(map(str, apart[kind].collect())) != []
        assert "MapInArrow" not in once[kind]._jdf.queryExecution().toString()


def test_batches_have_equal_numbers_of_files(spark):
    folder, sizes, met = scratch_folder(spark), [40, 1, 0, 25], []
    start = 0
    for k, n in enumerate(sizes):
        streams.put_batch(spark.range(start, start + n, 1, 4).select(F.col("id")), folder, k, 3)
        start += n
    for k in range(len(sizes)):
        assert len(spark.read.schema("id long").parquet(f"{folder}/b{k:08d}").inputFiles()) == 3
    stream = streams.in_batches(spark, spark.range(1).schema, folder, 3)
    query = stream.writeStream.foreachBatch(lambda df, i: met.append(sorted(r[0] for r in df.collect()))).option(
        "checkpointLocation", scratch_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [len(m) for m in met] == sizes
    assert [x for m in met for x in m] == list(range(sum(sizes)))


def test_partitions_follow_the_input(spark):
    own = measured_session(spark)
    fine_shuffles(own, 100 * 2**20)
    assert int(own.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 50
    assert own.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(8 * 2**20)
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "700")
    fine_shuffles(own, 100 * 2**20)
    assert own.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "700"
    assert own.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(4 * 2**20)


def test_full_build_equals_refresh_of_nothing(spark):
    make = lambda rows, columns: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    given = {
        "calls": make([("p", "a", "b", "x.c", "high"), ("p", "a", "b", "x.c", "low"), ("p", None, "b", "x.c", "high"), ("p", "c", None, "y.c", "low"), ("p", "c", "a", None, "high"), ("p", "lost", "b", "x.c", None)],
                      ["project_id", "caller", "callee", "file", "confidence"]),
        "includes": make([("p", "x.c", "y.h"), ("p", "x.c", "y.h"), ("p", None, "y.h")], ["project_id", "src", "target"]),
        "module_symbols": make([("p", "a", "M"), ("p", "b", "N"), ("p", "c", None), (None, "a", "O")], ["project_id", "name", "module"]),
        "module_files": make([("p", "x.c", "X"), ("p", "y.h", "Y"), ("p", None, "Z")], ["project_id", "path", "module"]),
        "files": make([("p", "x.c", "compiled"), ("p", "y.h", None)], ["project_id", "path", "compile_status"]),
    }
    plus = {k: v.withColumn("sign", F.lit(1).cast("bigint")) for k, v in given.items()}
    want, _ = relations_refresh.refresh_relations(relations_refresh.empty_state(spark), plus)
    got = relations_refresh.relation_state(**given)
    for table in relations_refresh.STATE:
        assert got[table].schema.names == want[table].schema.names
        assert sorted(map(str, got[table].collect())) == sorted(map(str, want[table].collect())), table
