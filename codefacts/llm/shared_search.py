"""Ranked lexical search of many queries at once: sums that queries have in common are formed once per document.

The score of a document for a query is the sum of the weights of their common terms. Term sets that several queries share are
mined first: terms that the same queries hold become one set, and pairs of sets that occur together in most queries are
merged again and again. The sets form a graph in which each node is the sum of two or more others. A task materialises the
partial sums of all nodes for a block of documents, each once, and a query adds the few nodes that are left of it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.llm.common import cut_lineage, drop_lineage

#: A term is a maximal run of digits, letters A to Z and characters above 127.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Pairs of a query and a term that a block of queries has, about; what a task holds of the queries follows from it.
BLOCK_TERMS = 100_000
#: Nodes of a query whose pairs are counted together when sets are mined.
MINED_TOGETHER = 64
#: Cells of the table of partial sums that a task holds, about.
CELLS = 4_000_000


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_SEPARATE).split()


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_sets(queries: dict[int, list[int]]) -> tuple[list[list[int]], dict[int, list[int]]]:
    """Graph of the term sets that queries (number to distinct terms) share.

    Returns the nodes, each the list of what it sums — terms as they are, earlier nodes as ``-1 - position`` — and for every query
    what it adds up. The sums of a query hold each of its terms once. A node with a single use is never made.
    """
    holders = defaultdict(list)
    for q in sorted(queries):
        for t in queries[q]:
            holders[t].append(q)
    alike = defaultdict(list)
    for t in sorted(holders):
        alike[tuple(holders[t])].append(t)
    nodes: list[list[int]] = []
    parts: dict[int, list[int]] = {q: [] for q in queries}
    uses: dict[int, set[int]] = {}
    for own, terms in sorted(alike.items()):
        if len(own) == 1 or len(terms) == 1:
            for q in own:
                parts[q] += terms
            if len(own) > 1:
                uses[terms[0]] = set(own)
        else:
            nodes.append(terms)
            uses[-len(nodes)] = set(own)
            for q in own:
                parts[q].append(-len(nodes))
    pairs: Counter = Counter()
    for q in parts:
        shared = sorted((x for x in parts[q] if x in uses), key=lambda x: (-len(uses[x]), x))
        for at in range(0, len(shared), MINED_TOGETHER):
            near = shared[at : at + MINED_TOGETHER]
            pairs.update((min(a, b), max(a, b)) for i, a in enumerate(near) for b in near[i + 1 :])
    heap = [(-n, pair) for pair, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    held = {q: set(p) for q, p in parts.items()}
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = uses[a] & uses[b]
        if len(both) < 2:
            continue
        if len(both) < -n:  # the count fell since it was filed
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        nodes.append([a, b])
        node = -len(nodes)
        uses[node] = both
        uses[a], uses[b] = uses[a] - both, uses[b] - both
        near = Counter()
        for q in sorted(both):
            held[q] -= {a, b}
            if len(held[q]) <= 2 * MINED_TOGETHER:
                near.update(x for x in held[q] if x in uses)
            held[q].add(node)
        for x, m in near.items():
            if m > 1:
                heapq.heappush(heap, (-m, (min(x, node), max(x, node))))
    return nodes, {q: sorted(p) for q, p in held.items()}


def _postings(numbers: dict[bytes, int]):
    """``doc_id``, number of terms, and the terms of queries in it with their occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.keys()
        for batch in batches:
            sizes, codes, times = [], [], []
            for raw in batch.column(1).to_pylist():
                words = terms_of(raw or b"")
                held = Counter(words)
                own = sorted((numbers[w], held[w]) for w in held.keys() & known)
                sizes.append(len(words))
                codes.append([c for c, _ in own])
                times.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(codes, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n", "codes", "times"])

    return rows


def _best(queries: np.ndarray, scores: np.ndarray, docs: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` best of each query, equal scores by document."""
    order = np.lexsort((docs, -scores, queries))
    queries, scores, docs = queries[order], scores[order], docs[order]
    first = np.flatnonzero(np.diff(queries, prepend=-1))
    rank = np.arange(len(queries)) - np.repeat(first, np.diff(np.append(first, len(queries))))
    kept = rank < top
    return queries[kept], scores[kept], docs[kept]


def _ranked(nodes: list[list[int]], parts: list[list[int]], weights: np.ndarray, documents: int, words: int, top: int):
    """Best documents of every query among those of a partition; null ids come as the largest number."""
    terms = len(weights)
    # one index for all: terms first, then nodes in the order they were made
    place = lambda x: x if x >= 0 else terms - 1 - x
    inner = [np.array([place(x) for x in own]) for own in nodes]
    outer = [np.array([place(x) for x in own], np.int64) for own in parts]
    block = max(16, CELLS // (terms + len(nodes) + len(parts) + 1))
    last = np.iinfo(np.int64).max

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64),) * 3
        floor = np.zeros(len(parts), np.int64)  # scores below cannot be among the best of a query
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                size = part.num_rows
                docs = part.column(0).fill_null(last).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                codes, times = part.column(2), part.column(3)
                owner = np.repeat(np.arange(size), np.diff(codes.offsets.to_numpy()))
                code, tf = codes.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
                m = 100 - 90 + (90 * n * documents) // words
                sums = np.zeros((terms + len(nodes), size), np.int64)
                sums[code, owner] = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
                for i, own in enumerate(inner):
                    sums[own].sum(axis=0, out=sums[terms + i])
                total = np.stack([sums[own].sum(axis=0) for own in outer])
                q, d = np.nonzero((total > 0) & (total >= floor[:, None]))
                best = _best(np.append(best[0], q), np.append(best[1], total[q, d]), np.append(best[2], docs[d]), top)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(parts)) >= top)
                least = np.full(len(parts), last)
                np.minimum.at(least, best[0], best[1])
                floor[full] = least[full]
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2], mask=best[2] == last)], ["query", "score", "doc_id"])

    return rows


def _block(queries: DataFrame, docs: DataFrame, top: int) -> DataFrame | None:
    """Candidates (``item_id``, ``score``, ``doc_id``) of one block of queries: the best of every partition."""
    spark = docs.sparkSession
    own = defaultdict(set)
    for r in queries.collect():  # a block, see BLOCK_TERMS
        own[r["item_id"]].add(r["term"])
    if not own:
        return None
    ids = sorted(own, key=lambda x: (x is None, x))
    numbers = {t.encode(): i for i, t in enumerate(sorted(set().union(*own.values())))}
    nodes, parts = shared_sets({q: sorted(numbers[t.encode()] for t in own[x]) for q, x in enumerate(ids)})
    held = cut_lineage(docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
                       .mapInArrow(_postings(numbers), "doc_id long, n long, codes array<int>, times array<int>").where("n > 0"))
    total = held.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    if not total["n"]:
        return None
    documents, words = int(total["n"]), int(total["words"])
    seen = dict(held.select(F.explode("codes").alias("code")).groupBy("code").count().collect())
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * seen.get(c, 0) + 1))) for c in range(len(numbers))], np.int64)
    found = held.where(F.size("codes") > 0).mapInArrow(_ranked(nodes, [parts[q] for q in range(len(ids))], weights, documents, words, top), "query long, score long, doc_id long")
    kind = T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", queries.schema["item_id"].dataType)])
    found = cut_lineage(found.join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), kind)), "query").select("item_id", "score", "doc_id"))
    drop_lineage(held)
    return found


def search(items: DataFrame, docs: DataFrame, top: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``top`` documents with a score above 0 for each item.

    Terms are the maximal matches of TERM in whole texts, A to Z in lower case; an item asks for each of its terms once.
    A null text has no terms; items without terms and documents without any of them give no rows. Equal scores go by doc_id,
    null ids last; repeated documents rank each; repeated items rank once, the terms of one item_id are united. Other columns
    are ignored; empty tables give no rows. Items are taken in blocks by a hash of their ids; an item is never cut, however long.
    """
    queries = cut_lineage(items.select("item_id", F.explode(F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("term")).distinct())
    blocks = max(1, math.ceil(queries.count() / block_terms))
    found = [_block(queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), docs, top) for b in range(blocks)]
    out = docs.sparkSession.createDataFrame([], T.StructType([queries.schema["item_id"], T.StructField("score", T.LongType()), T.StructField("doc_id", T.LongType())]))
    for f in found:
        out = out if f is None else out.unionByName(f)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # ranks of partial groups first, so that no task gathers all candidates of an item
    part = F.row_number().over(Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order))
    out = out.withColumn("rank", part).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")
