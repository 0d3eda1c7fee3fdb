"""The metric range join against all pairs."""

import numpy as np
import pytest

from codefacts.llm import metric_join


def brute(rows, cosine):
    ids = [r[0] for r in rows]
    good = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((ids[i] if ids[i] is not None else -1, len(links[i]), min(ids[j] if ids[j] is not None else -1 for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("block", [7, 2048])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(6, 8))
        for k in range(120):
            v = centres[k % 6] * (1 + rng.random()) + rng.normal(size=8) * rng.choice([0.02, 0.2, 0.5, 1.5])
            rows.append((label * 1000 + k, [float(x) for x in v.astype(np.float32)], label))
    rows += [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [float("nan")] + [1.0] * 7, 1), (5003, [1.0, None] + [1.0] * 6, 1), (5004, [1.0] * 8, None), (5005, [], 1), (5006, [1.0, 2.0], 1),
             (5007, [2.0, 4.0], 1), (5008, rows[0][1], 0), (5009, rows[0][1], 0), (5010, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' as cell", "1 as node").repartition(5)
    got = metric_join.linked(vectors, block=block, pivots=5).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute(rows, 0.93)
    assert metric_join.linked(vectors.where("false")).count() == 0
