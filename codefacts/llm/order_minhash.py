"""Near duplicates by Order MinHash with banded alignment.

A document is its sequence of five-word shingles. One sketch takes the few shingles with the smallest hashes, all repeats
of a shingle told apart by an occurrence number, and keeps them in text order, so it is equal for two texts only when both
hold the same sample in the same order: that follows edit similarity, not just set overlap. Texts that share a sketch are
candidates. The similarity of a pair is the longest common subsequence of the two shingle sequences over the shingles of
both less that subsequence (the Jaccard similarity that respects order); a banded alignment decides it exactly.

Groups of copies are never paired with each other. Equal word sequences collapse to one content first. In rounds, each
content is aligned with one head per bucket (a star) unless both are connected by then; every bucket has a head of its own
choosing, so a loose family meets many of its members; the last star rounds take buckets of three sketches together and align
what lies outside a bucket's largest component with one head of that component. What then
lies outside the largest component of a bucket of one sketch is aligned with the contents of other components in it, unless
their signatures differ by five standard deviations more than those of a pair at the threshold. So every pair that shares a
sketch at all is connected or compared. A tight group of a million near
copies thus costs about a million alignments. In a loose family whose members are alike but mostly below the threshold, a
member that links to nothing still has its signature compared with each member it shares a bucket with.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import components
from codefacts.session import cut_lineage, drop_lineage

SHINGLE = 5
SKETCHES = 18
TAKEN = 3
SIMILARITY = 0.8
ROUNDS = 4
#: Triples of sketches whose buckets the last star rounds use; the pass after them covers all sketches.
TRIPLES = 96
#: Bits of the signature that tells how alike two contents of a crowded bucket are before their texts are fetched.
BITS = 2048

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _STEP
    return x ^ (x >> np.uint64(29))


#: An odd multiplier per hash function, drawn independently; the items they multiply are mixed before.
_ODD = mixed(mixed(np.arange(1, BITS + 1, dtype=np.uint64) * _MIX)) | np.uint64(1)


def shingles(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``k`` words in text order; a shorter text is one shingle, an empty one none."""
    if len(codes) == 0:
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    n = len(codes) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = mixed(total * _MIX + codes[j : j + n].astype(np.uint64) + np.uint64(1))
    return total


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a shingle in the text, 1 for the second, …"""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
    seen = np.empty(len(ranked), np.int64)
    seen[order] = np.arange(len(ranked)) - start
    return seen


def items_of(words: list[bytes] | np.ndarray) -> np.ndarray:
    """The occurrence-labelled shingles of a text in text order, from its words or their codes.

    They are the items of sketches and signatures only. The alignment takes the shingles as they are: after one edit in
    a repeated passage the labels of all later repeats shift, their order does not.
    """
    hashes = shingles(words if isinstance(words, np.ndarray) else word_codes(words))
    return mixed(hashes + occurrences(hashes).astype(np.uint64) * _MIX)


def sketches(items: np.ndarray, count: int = SKETCHES, taken: int = TAKEN) -> list[int]:
    """One 64-bit key per hash function: its ``taken`` smallest labelled shingles, in text order."""
    if len(items) == 0:
        return []
    keys = []
    rows = max(1, min(count, 200_000 // len(items)))  # so many functions at a time: long texts need no wide matrix
    for i in range(0, count, rows):
        odd = _ODD[i : min(i + rows, count), None]
        if len(items) <= taken:
            at = np.tile(np.arange(len(items)), (len(odd), 1))
        else:
            at = np.sort(np.argpartition(items[None, :] * odd, taken - 1, axis=1)[:, :taken], axis=1)
        for f, chosen in enumerate(items[at].tolist(), i):
            key = f + 1
            for h in chosen:
                key = _chain(key, h)
            keys.append(key - 2**64 if key >= 2**63 else key)
    return keys


def _chain(key: int, h: int) -> int:
    x = ((key ^ h) * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float | None:
    """Order-respecting similarity of two shingle sequences, or None below ``threshold``.

    At the threshold the two differ by at most ``(1 - t) / (1 + t)`` of their summed length, so an alignment that
    leaves a diagonal band of that half-width cannot reach it. Inside the band the rows of the dynamic program are
    bit vectors (a zero marks a column where the subsequence grows), one shift and one addition per row.
    """
    size = len(a) + len(b)
    if size == 0:
        return 1.0
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return None
    if _shared(a, b) < threshold / (1 + threshold) * size - 1e-9:  # no order of the common shingles reaches it
        return None
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(unlike[0]) if len(unlike) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    common = head + tail + _banded_lcs(a, b, int((1 - threshold) / (1 + threshold) * size) + 1)
    similarity = common / (size - common)
    return similarity if similarity >= threshold else None


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles of both, repeats counted: the longest common subsequence is no longer."""
    both = np.sort(np.concatenate([x + occurrences(x).astype(np.uint64) * _MIX for x in (a, b)]))
    return int((both[1:] == both[:-1]).sum())


def _banded_lcs(a: np.ndarray, b: np.ndarray, half: int) -> int:
    shared = np.intersect1d(a, b)
    if len(shared) == 0:
        return 0
    places: dict[int, list[int]] = {}
    for p in np.flatnonzero(np.isin(a, shared)).tolist():
        places.setdefault(int(a[p]), []).append(p)
    dense = {h: sum(1 << p for p in ps) for h, ps in places.items() if len(ps) * len(ps) > len(a)}
    width = 2 * half + 1
    full = (1 << width) - 1
    row, low, grown = full, 0, 0  # bit i of row is column low + i; columns left of the band are already counted
    for j, h in enumerate(b.tolist()):
        if j - half > low:
            step = j - half - low
            gone = row & ((1 << step) - 1)
            grown += step - gone.bit_count()
            row = (row >> step) | (((1 << step) - 1) << (width - step))
            low += step
        if h in dense:
            match = (dense[h] >> low) & full
        else:
            match = 0
            for p in places.get(h, ()):
                if low <= p < low + width:
                    match |= 1 << (p - low)
        if match:
            row = ((row + (row & match)) | (row & ~match)) & full
    return grown + width - row.bit_count()


def content_key(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def _sketch_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        words = [words_of(t) for t in frame["text"]]
        items = [items_of(w) for w in words]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "content": [content_key(w) for w in words], "n": [len(x) for x in items], "keys": [sketches(x) for x in items]})


def _code_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        words = [words_of(t) for t in frame["text"]]
        yield pd.DataFrame({"content": [content_key(w) for w in words], "codes": [word_codes(w).tobytes() for w in words]})


def _verified(threshold: float):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seq = lambda x: shingles(np.frombuffer(x, np.uint32))
            found = [aligned(seq(x), seq(y), threshold) for x, y in zip(frame["codes_a"], frame["codes_b"], strict=True)]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": [x if x is not None else -1.0 for x in found]})

    return rows


def signature(items: np.ndarray) -> np.ndarray:
    """One bit per hash function: a bit of its smallest item. Two texts of Jaccard similarity s differ in (1 - s) / 2 of the bits."""
    least = np.zeros(BITS, np.uint64)
    rows = max(1, 200_000 // max(1, len(items)))
    for i in range(0, BITS if len(items) else 0, rows):
        least[i : i + rows] = (items[None, :] * _ODD[i : i + rows, None]).min(axis=1)
    return np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _signature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"content": frame["content"], "bits": [signature(items_of(np.frombuffer(c, np.uint32))) for c in frame["codes"]]})


def _plausible(a: str, b: str, threshold: float) -> Column:
    """Signatures differ by at most five standard deviations more than at ``threshold``; the shared items bound the alignment."""
    share = (1 - threshold) / 2
    most = int(BITS * share + 5 * (BITS * share * (1 - share)) ** 0.5)
    return reduce(add, (F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(BITS // 64))) <= most


def _first_sketch(a: str, b: str) -> Column:
    """Position of the first sketch two contents share: the one bucket that lists their pair."""
    found = F.lit(None).cast("int")
    for i in reversed(range(SKETCHES)):
        found = F.when(F.get(a, i) == F.get(b, i), F.lit(i)).otherwise(found)
    return found


def _triples() -> list[tuple[int, int, int]]:
    """TRIPLES of the sketches, spread evenly over all."""
    every = list(combinations(range(SKETCHES), 3))
    return [every[i * 389 % len(every)] for i in range(TRIPLES)]


def sketch_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``content`` (digest of the word sequence), ``n`` shingles and the sketch ``keys`` of every row."""
    return docs.select("doc_id", "text").mapInPandas(_sketch_rows, "doc_id bigint, content binary, n bigint, keys array<bigint>")


def _outsiders(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed(key, content, component, …)`` outside the largest component of their bucket, with a ``head`` from that one.

    A large component that one outsider shares its buckets with gives one head per bucket, not all its rows.
    """
    parts = keyed.groupBy("key", "component").agg(F.count("*").alias("members"), F.min_by("content", F.xxhash64("content", "key")).alias("head"))
    tops = parts.groupBy("key").agg(F.max_by(F.struct("component", "head"), F.struct("members", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    tops = tops.select(F.col("key").alias("_key"), F.col("top.component").alias("_top"), F.col("top.head").alias("head"))
    return keyed.join(tops, (F.col("key") == F.col("_key")) & (F.col("component") != F.col("_top"))).drop("_key", "_top")


def near_duplicate_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``content``, ``class_id`` (smallest doc_id linked, directly or through others), ``kept``.

    One row per row of ``docs``; other columns are ignored. A null text is empty, empty texts are copies of each other.
    Texts under five words are one shingle, so they link to copies only. ``kept`` is true where doc_id is the class id;
    rows that repeat a doc_id with the same text are all marked alike. Rows with a null doc_id are compared with
    nothing: class null, kept true. The empty table gives no rows.
    """
    rows = cut_lineage(sketch_table(docs))
    contents = rows.where("doc_id is not null").groupBy("content").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("doc_id").alias("first_id"))
    alike = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")

    def bucketed(keyed: DataFrame) -> DataFrame:
        heads = keyed.groupBy("key").agg(F.min_by("content", F.xxhash64("content", "key")).alias("head"), F.count("*").alias("members")).where("members > 1")
        return cut_lineage(keyed.join(heads.drop("members"), "key"))

    singles = bucketed(contents.select("content", "n", F.posexplode("keys").alias("i", "h")).select("content", "n", "i", F.xxhash64("i", "h").alias("key")))
    asked = singles.select("content").distinct()
    text_of = contents.join(asked, "content", "left_semi").select(F.col("first_id").alias("doc_id")).distinct()
    codes = cut_lineage(docs.select("doc_id", "text").join(text_of, "doc_id", "left_semi")
                        .mapInPandas(_code_rows, "content binary, codes binary").join(asked, "content", "left_semi").dropDuplicates(["content"]))

    def links(pairs: DataFrame) -> DataFrame:
        left = codes.select(F.col("content").alias("a"), F.col("codes").alias("codes_a"))
        right = codes.select(F.col("content").alias("b"), F.col("codes").alias("codes_b"))
        # the codes are small and the alignment is not: the tasks go by cores, not by bytes
        spread = pairs.select("a", "b").join(left, "a").join(right, "b").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "a", "b")
        found = spread.mapInPandas(_verified(threshold), "a binary, b binary, similarity double")
        return cut_lineage(found.where("similarity >= 0").select("a", "b"))

    def placed(buckets: DataFrame, classes: DataFrame | None, name: str, out: str) -> DataFrame:
        if classes is None:
            return buckets.withColumn(out, F.col(name))
        known = classes.select(F.col("node").alias(name), F.col("component").alias("_c"))
        return buckets.join(known, name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")

    classes = None
    sizes = contents.select(F.col("content").alias("head"), F.col("n").alias("n_a"))

    def star_round(stars: DataFrame) -> None:
        """Aligns the contents of ``stars(head, content, n_b)`` with the heads of other components."""
        nonlocal classes
        apart = placed(placed(stars, classes, "head", "ca"), classes, "content", "cb").where("ca <> cb")
        new = links(apart.join(sizes, "head").where(alike).select(F.col("head").alias("a"), F.col("content").alias("b")))
        classes = joined(classes, new)
        drop_lineage(new)

    def joined(classes: DataFrame | None, new: DataFrame) -> DataFrame:
        """The components after ``new`` links: only whole components are joined, not the links before once more."""
        if classes is None:
            return components(new)
        between = placed(placed(new, classes, "a", "ca"), classes, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(between)
        alone = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti").select("node", F.col("node").alias("component"))
        to = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        out = cut_lineage(classes.unionByName(alone).join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component")))
        drop_lineage(merged)
        drop_lineage(classes)
        return out

    for turn in range(ROUNDS):
        star_round(singles.where((F.col("i") % ROUNDS == turn) & (F.col("content") != F.col("head"))).select("head", "content", F.col("n").alias("n_b")).distinct())
    triples = F.array(*[F.struct(*[F.lit(x) for x in t]) for t in _triples()])
    key = lambda t: F.xxhash64(t["col1"], t["col2"], t["col3"], F.get("keys", t["col1"]), F.get("keys", t["col2"]), F.get("keys", t["col3"]))
    met = contents.join(asked, "content", "left_semi").select("content", "n", "keys")
    for turns in (8, 1):  # texts that share a triple are alike, so their heads settle most of what is left
        every = placed(met, classes, "content", "component").select("content", "n", "component", F.posexplode(F.transform(triples, key)).alias("i", "key"))
        star_round(cut_lineage(_outsiders(every.where(F.col("i") % turns == 0)).select("head", "content", F.col("n").alias("n_b")).distinct()))
    keyed = placed(singles.drop("head"), classes, "content", "component")
    several = keyed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    keyed = cut_lineage(keyed.join(several, "key", "left_semi"))
    drop_lineage(singles)
    crowd = codes.join(keyed.select("content").distinct(), "content", "left_semi").mapInPandas(_signature_rows, "content binary, bits array<bigint>")
    before, keyed = keyed, cut_lineage(keyed.join(crowd, "content").join(contents.select("content", "keys"), "content"))
    drop_lineage(before)
    tops = keyed.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("top"))
    rest = keyed.join(tops, "key").where("component <> top").select("key", F.col("content").alias("x"), F.col("n").alias("n_a"), F.col("component").alias("cx"), F.col("bits").alias("bits_x"), F.col("keys").alias("keys_x"), "i", "top")
    every = keyed.select("key", F.col("content").alias("y"), F.col("n").alias("n_b"), F.col("component").alias("cy"), F.col("bits").alias("bits_y"), F.col("keys").alias("keys_y"))
    once = (F.col("cy") == F.col("top")) | (F.col("x") < F.col("y"))  # a pair of two outsiders comes from both ends
    listed = (_first_sketch("keys_x", "keys_y") == F.col("i")) & _plausible("bits_x", "bits_y", threshold)
    across = rest.join(every, (rest["key"] == every["key"]) & (F.col("cx") != F.col("cy")) & once & alike & listed).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    across = cut_lineage(across)
    last = links(across)
    drop_lineage(across)
    drop_lineage(keyed)
    drop_lineage(codes)
    final = joined(classes, last).withColumnRenamed("node", "content")
    drop_lineage(last)
    named = contents.select("content", "first_id").join(final, "content", "left").withColumn("component", F.coalesce("component", "content"))
    least = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    classes = named.join(least, "component").select("content", "class_id")
    known = rows.where("doc_id is not null").select("doc_id", "content").join(classes, "content").select("doc_id", "content", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    unknown = rows.where("doc_id is null").select("doc_id", "content", F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("kept"))
    return known.unionByName(unknown)


def without_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their class, all columns kept.

    One row of each class stays: that of the smallest doc_id, once where rows repeat it. Rows with a null doc_id stay.
    """
    kept = near_duplicate_classes(docs, threshold).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    known = docs.join(kept, docs["doc_id"] == F.col("_kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.where("doc_id is null"))
