"""Held-out accuracy of the classifiers, exact packing, and the pipeline against its parts."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codefacts.llm import catalog, compression, packing, toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return query(spark, FOLDER).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, catalog.op7_quality, "quality")
    assert (got["predicted"] == got["y"]).mean() > 0.95 and (got.loc[got["y"] == 1, "predicted"] == 1).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, catalog.op8_toxicity, "toxic")
    assert (got.loc[got["y"] == 1, "predicted"] == 1).mean() > 0.9 and (got.loc[got["y"] == 0, "predicted"] == 0).mean() > 0.98


def test_swapped_terms_do_not_move_the_score():
    rng = random.Random(3)
    filler = lambda: " ".join(f"w{rng.randrange(200)}" for _ in range(20))
    examples = [(1, f"{filler()}. the muslim people are vermin {rng.randrange(9)}. {filler()}") for _ in range(60)] + [(0, f"{filler()}. {filler()}") for _ in range(90)] + [(0, f"a christian people met. {filler()}") for _ in range(30)]
    free, tied = toxicity.fit(examples, penalty=0.0), toxicity.fit(examples)
    gap = lambda w: abs(w.get("muslim", 0) + w.get("musl*", 0) + w.get("musli*", 0) - w.get("christian", 0) - w.get("chri*", 0) - w.get("chris*", 0) - w.get("christ*", 0))
    assert gap(tied) < 0.25 * gap(free)
    score = lambda w, t: w[""] + sum(w.get(f, 0) for f in toxicity.features_of(toxicity.words_of(t)))
    assert score(tied, "the muslim people met for tea") < 0 < score(tied, "they are vermin people, vermin are the worst")


def test_models_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a", 9), (2, None, 9), (None, "", 9), (2, None, 9)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in compression.quality(docs, labels, F.lit(True)).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()} == {0}
    assert toxicity.without_toxic(docs, toxicity.fit([])).count() == docs.count()
    assert toxicity.without_toxic(docs.where("false"), {"": 0.0}).count() == 0 and compression.scored(docs.where("false"), compression.fit([])).count() == 0
    long = "bad words " * 30_000
    models = compression.fit([(0, long + str(i)) for i in range(9)] + [(1, f"quiet reading number {i} of the good text") for i in range(9)])
    assert 0 <= models.score(long) < 0.5 < models.score("quiet reading number 77 of the good text")


def test_encoding_is_that_of_the_whole_text():
    path = public_tokenizers.path(packing.TOKENIZER)
    plain = Tokenizer.from_file(path)
    rng = random.Random(9)
    bits = ["It's", "<|endoftext|>", "naïve", "ÉCOLE's", " ", "\n", " ", "x1y2", "ΣΑΣ", "İx", "ﬁ", "日本語", "x́", "'LL", "don't.", "<|", "ǅ", "ſ", "K", "...", "a", "Ab,", "\x85", "٣", "#$%"]
    for text in ["", "  ", *("".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(2000))]:
        assert packing.encode([text], path)[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(spark):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 150_000), (None, "x")], "doc_id bigint, text string")).withColumn("start", F.lit("clash"))
    pieces = packing.packed(docs, shard_tokens=60_000).toPandas()
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    for doc_id, own in pieces.groupby("doc_id", dropna=False):
        want, at = ids[None if np.isnan(doc_id) else int(doc_id)], 0
        for p in own.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(want)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(want[p.start : at], "<u4").tobytes())
        assert at == len(want)
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 2048
    full = pieces.groupby("sequence_id")["length"].sum()
    assert (full < 2048).sum() <= np.ceil(sum(map(len, ids.values())) / 30_000) + 1
    assert packing.packed(docs.where("false")).count() == 0


def test_neighbours_share_a_window():
    rng = np.random.default_rng(1)
    docs = [rng.integers(1000 * topic, 1000 * topic + 60, 300).astype(np.uint16) for _ in range(6) for topic in (1, 2, 3, 4, 5)]
    first = {p[0] for p in packing.fill(docs, 1800) if p[3] == 0}
    assert first == {0, 5, 10, 15, 20, 25}


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(None, "null id", "en", "s", 7), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    at = docs.unionByName(extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.cut_lineage(stage(spark, at, folder))
        assert at.columns == docs.columns and at.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, at, folder).count() >= at.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
