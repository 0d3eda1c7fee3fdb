"""Order MinHash against all pairs, and its edge cases."""

import random

import numpy as np
import pytest

from codefacts.llm import order_minhash as om
from codefacts.llm.common import components


def subsequence(a, b):
    row = np.zeros(len(b) + 1, int)
    for x in a:
        grown = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(grown)
    return row[-1]


def ordered_similarity(a, b):
    if not len(a) + len(b):
        return 1.0
    common = subsequence(a, b)
    return common / (len(a) + len(b) - common)


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(rng.choice([3, 40, 1000])) for _ in range(rng.randrange(90))]
        b = [x for x in a if rng.random() > 0.05]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(40))
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        want, got = ordered_similarity(a, b), om.aligned(a, b)
        assert (got is None) == (want < 0.8) and (got is None or abs(got - want) < 1e-12)


def corpus(rng, words=120):
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    shared = text(60)
    for _ in range(40):
        base = text(rng.randrange(8, words))
        rows.append(base)
        for _ in range(rng.randrange(5)):
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append(near)
        rows.append(base[len(base) // 2 :] + base[: len(base) // 2])
        rows.append(text(30) + shared + text(30))
    return [" ".join(r) for r in rows]


def brute_classes(texts):
    runs = [om.items_of(om.words_of(t)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(runs[i]), len(runs[j])) >= 0.8 * max(len(runs[i]), len(runs[j])) and ordered_similarity(runs[i], runs[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_classes_equal_all_pairs(spark):
    texts = corpus(random.Random(5)) + ["", "", "one two", "one  two\n", "one three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicate_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = om.without_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_hot_group_is_one_class_without_its_pairs(spark):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(80)]
    texts = []
    for _ in range(600):
        near = list(base)
        near[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    assert {r["class_id"] for r in om.near_duplicate_classes(docs).collect()} == {0}


def test_a_common_line_does_not_link(spark):
    rng = random.Random(8)
    texts = [" ".join(["the same line again."] * 60 + [f"v{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert om.near_duplicate_classes(docs).select("class_id").distinct().count() == 50


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (2, "a b c d e f", None), (None, "a b c d e f", "k"), (None, None, None), (3, None, "k"), (4, "", "k"), (5, " ".join(f"x{i}" for i in range(30_000)), "k"), (6, " ".join(f"x{i}" for i in range(30_001)), "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, content string")
    out = om.near_duplicate_classes(docs).select("doc_id", "class_id", "kept").collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in out) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)]
    kept = om.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 5]
    assert om.near_duplicate_classes(docs.where("false")).count() == 0 and om.without_near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_chain(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(None, 1), (90, 90)], "a bigint, b bigint")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(i, 0) for i in range(n + 1)}


def plain_classes(texts):
    """By the shingles of whole texts, no occurrence left out."""
    runs = [om.shingles(om.word_codes(t.encode().split())) for t in texts]
    joined = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if joined[i] != joined[j] and ordered_similarity(runs[i], runs[j]) >= 0.8:
                low, high = sorted((joined[i], joined[j]))
                joined = [low if x == high else x for x in joined]
    return joined


def test_all_repeats_of_a_passage_count(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(100)]
    edited = [w if rng.random() > 0.01 else f"e{rng.randrange(10**6)}" for w in passage * 20]
    other = [f"q{i}" for i in range(400)]
    texts = [" ".join(t) for t in (passage * 20, edited, passage * 20 + other, passage * 12, passage * 4 + other, other + passage * 4)]
    want = plain_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(10, "x " * 30_000), (11, "x " * 30_000 + "y")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicate_classes(docs).collect()}
    assert want[1] == 0 and [got[i] for i in range(len(texts))] == want and (got[10], got[11]) == (10, 10)


def test_every_pair_of_a_loose_family_that_shares_a_sketch_is_compared(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]

    def edited(places):
        return " ".join(f"e{rng.randrange(10**6)}" if i in places else w for i, w in enumerate(base))

    places = [set(rng.sample(range(5, 145), 3)) for _ in range(250)]
    texts = [edited(p) for p in places for _ in range(2)]  # two that differ from the base in the same places share base words only
    runs = [om.shingles(om.word_codes(om.words_of(t))) for t in texts]
    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if om.aligned(runs[j], runs[i]) is not None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicate_classes(docs).collect()}
    assert len(pairs) > 200 and [(a, b) for a, b in pairs if got[a] != got[b]] == []


def test_a_crowded_bucket_gives_its_outsiders_only(spark):
    rows = [("k", f"c{i:03}", "big") for i in range(200)] + [("k", "x", "x"), ("k", "y", "y")] + [("one", f"c{i:03}", "big") for i in range(50)]
    got = om._outsiders(spark.createDataFrame(rows, "key string, content string, component string")).collect()
    assert sorted((r["key"], r["content"]) for r in got) == [("k", "x"), ("k", "y")]
    assert {r["head"][0] for r in got} == {"c"}
