"""Periodic runs, genetic packing and shared search against brute force, with the cases that tables may hold."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codefacts.llm import catalog, genetic_packing, runs, shared_search, tokens


def brute_runs(x, least_words, least_periods):
    out = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            size = i + q - s
            smaller = any(all(x[k] == x[k + d] for k in range(s, s + size - d)) for d in range(1, q))
            if size >= least_words and size >= least_periods * q and not smaller:
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [(24, 3), (4, 2), (9, 3), (10, 4)])
def test_runs_are_those_of_brute_force(least):
    rng = random.Random(sum(least))
    for _ in range(400):
        x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 110))]
        if x and rng.random() < 0.7:
            a, p = rng.randrange(len(x)), rng.randint(1, 12)
            x = [*x[:a], *([*x[a:]][(i - a) % min(p, len(x) - a)] for i in range(a, len(x))), *(rng.randrange(3) for _ in range(rng.randint(0, 20)))]
        assert runs.runs_of(x, *least) == brute_runs(x, *least)


def test_runs_of_hard_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    word = list(fib[-1][:500])
    assert runs.runs_of(word, 24, 3) == brute_runs(word, 24, 3) != []
    assert runs.runs_of(list("ab") * 100_000) == [(0, 200_000, 2)]
    assert runs.runs_of([str(i % 9000) for i in range(30_000)]) == [(0, 30_000, 9000)]
    assert runs.runs_of([bin(i).count("1") % 2 for i in range(20_000)]) == []  # no word three times in a row


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab c d é x\u0085y".split(" ")) for _ in range(rng.randint(0, 200))), "x") for i in range(400)]
    rows += [(1500, None, "x"), (1501, "", "x"), (1502, " \t\n\x0b\f\r ", "x"), (None, "of " * 40, "x"), (503, "one two\n" * 30, "x"), (503, "one two\n" * 30, "x"), (504, "w " * 50_000, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = Counter()
    for doc_id, text, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, len(words)))]
        found = brute_runs(words, 24, 3) if len(words) < 1000 else [(0, len(words), 1)]
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        by[(doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())] += 1
    assert by == Counter(tuple(r) for r in got)
    assert sum(r["n_runs"] for r in got) > 10
    empty = runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.count() == 0


def test_best_fit_takes_the_fullest_bin_that_fits():
    rng = random.Random(2)
    sizes = [rng.randint(1, 40) for _ in range(500)]
    room, want = [7, 0, 40], []
    own = list(room)
    for s in sizes:
        fits = [b for b, r in enumerate(own) if r >= s]
        want.append(min((own[b] for b in fits), default=None))
        if fits:
            own[min(fits, key=lambda b: own[b])] -= s
        else:
            own.append(40 - s)
    bins = genetic_packing.best_fit(sizes, room, 40)
    assert sorted(room) == sorted(own) and len(bins) == 500 and max(bins) < len(room)


def test_evolution_packs_better_than_its_founders():
    """Sizes that fill bins in one way only: best fit in any order misses it, crossover and repair find most of it."""
    rng = np.random.default_rng(5)
    cuts = [np.sort(rng.choice(np.arange(1, 1000), 2, replace=False)) for _ in range(120)]
    sizes = np.concatenate([np.diff([0, *c, 1000]) for c in cuts])
    people = genetic_packing.founders(sizes, 1000, 8, rng)
    before = max(genetic_packing.fitness(p, sizes, 1000) for p in people)
    evolved = genetic_packing.evolve(people, sizes, 1000, rng, generations=30)
    after = genetic_packing.fitness(evolved[0], sizes, 1000)
    assert after[0] > before[0] and -after[0] <= 122
    for p in evolved:
        assert np.bincount(p, weights=sizes).max() <= 1000 and len(p) == len(sizes)
    child = genetic_packing.cross(evolved[0], evolved[-1], sizes, 1000, rng)
    assert np.bincount(child, weights=sizes).max() <= 1000 and np.bincount(child).min() > 0


def test_genetic_packing_round_trip(spark):
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 30_000), (-4, "word " * 4095), (-5, "a b"), (-5, "a b")], "doc_id bigint, text string")).withColumn("bin", F.lit("clash"))
    pieces = genetic_packing.packed(docs, cell_tokens=60_000).toPandas()
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert len(pieces[pieces["doc_id"] == -5]) == 2
    for doc_id, own in pieces[pieces["doc_id"] != -5].groupby("doc_id"):
        at = 0
        for k, p in enumerate(own.sort_values("start").itertuples()):
            assert (p.start, p.piece) == (at, k) and p.length == min(4096, len(ids[doc_id]) - at)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc_id][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc_id])
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 4096
    rest = pieces[pieces["length"] < 4096]["length"].sum()
    assert pieces[pieces["length"] < 4096]["sequence_id"].nunique() <= math.ceil(rest / 4096) + 1
    assert genetic_packing.packed(docs.where("false")).count() == 0
    null = genetic_packing.packed(spark.createDataFrame([(None, "x"), (2**60 + 1, "x")], "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in null} == {None, 2**60 + 1}


def test_shared_sets_sum_to_the_terms():
    rng = random.Random(8)
    common = [rng.sample(range(200), 12) for _ in range(6)]
    queries = {q: sorted({*rng.sample(range(200), 5), *(t for c in rng.sample(common, 2) for t in c)}) for q in range(80)}
    queries[80], queries[81] = [], queries[3]
    nodes, parts = shared_search.shared_sets(queries)

    def terms(x):
        return [x] if x >= 0 else [t for y in nodes[-1 - x] for t in terms(y)]

    for q, own in queries.items():
        assert sorted(t for x in parts[q] for t in terms(x)) == own
    assert all(y >= 0 or -1 - y < i for i, own in enumerate(nodes) for y in own)
    shared = sum(map(len, nodes)) + sum(map(len, parts.values()))
    assert shared < 0.7 * sum(map(len, queries.values()))


def test_search_is_that_of_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["the", "Of", "naïve", "x1", "日本", "éa", *(f"w{i}" for i in range(60))]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ". "]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)] + [(7, "the the w1"), (7, "the the w1"), (None, "w2 w3"), (900, None), (901, "..."), (902, "w5 " * 60_000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(40)] + [(100, None), (101, "?!"), (102, "nowhere"), (3, "w9 w9"), (None, "w3")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n", F.lit(0))
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    find = lambda s: re.findall(shared_search.TERM, lower(s))
    held = [(i, Counter(find(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    want = []
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(find(t))
    for i, terms in asked.items():
        scored = []
        for doc, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            scored += [(-s, doc is None, doc)] * (s > 0)
        want += [(i, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:10], 1)]
    for block_terms in (100_000, 60):
        assert sorted(map(str, (tuple(r) for r in shared_search.search(q, d, block_terms=block_terms).collect()))) == sorted(map(str, want))
    assert shared_search.search(q, d.where("false")).count() == shared_search.search(q.where("false"), d).count() == 0
