"""Periodic runs of words, by a suffix automaton whose link tree keeps the last occurrence of every path segment.

The automaton of a text has one state for every prefix; the states above it along the suffix links are the suffixes of that
prefix. A link-cut forest over the links holds, for each preferred path, the position where its suffixes ended last. Appending a
word is one access: it walks from the state of the new prefix to the root and recolours the segments it meets with the new
position. A segment last seen at position c whose longest suffix has L words, with distance d = i - c at most L, is a square of
period d that ends at i; it starts at i - d - L + 1. Squares of one period and one start are one run, the last of them ends it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3


def suffix_links(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Links and lengths of the states of the suffix automaton (from 1; the root is 1), and the state of every prefix."""
    link, length, after = [0, 0], [0, 0], [{}, {}]
    last, prefixes = 1, []
    for code in codes:
        new = len(link)
        link.append(1)
        length.append(length[last] + 1)
        after.append({})
        at = last
        while at and code not in after[at]:
            after[at][code] = new
            at = link[at]
        if at:
            to = after[at][code]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                after.append(after[to].copy())
                link[to] = link[new] = twin
                while at and after[at].get(code) == to:
                    after[at][code] = twin
                    at = link[at]
        last = new
        prefixes.append(new)
    return link, length, prefixes


def squares(codes: list[int]) -> dict[tuple[int, int], int]:
    """Last end of the squares of each (start, period); the period is the smallest one of the words from start to end."""
    up, length, prefixes = suffix_links(codes)  # ``up``: parent in a splay tree, or the path above its root
    left, right, seen = [0] * len(up), [0] * len(up), [-1] * len(up)
    found: dict[tuple[int, int], int] = {}
    for now, state in enumerate(prefixes):
        below, node = 0, state
        while node:
            # splay ``node``; the root of the tree before, ``top``, knows where the path was last seen
            top, p = node, up[node]
            while p and (left[p] == node or right[p] == node):
                g = up[p]
                if g and (left[g] == p or right[g] == p):
                    top, above = g, up[g]
                    if (left[g] == p) == (left[p] == node):
                        if left[g] == p:
                            b, c = right[p], right[node]
                            left[g], right[p], left[p], right[node] = b, g, c, p
                        else:
                            b, c = left[p], left[node]
                            right[g], left[p], right[p], left[node] = b, g, c, p
                        up[g], up[p] = p, node
                        if b:
                            up[b] = g
                        if c:
                            up[c] = p
                    else:
                        if left[g] == p:
                            b, c = left[node], right[node]
                            right[p], left[g], left[node], right[node] = b, c, p, g
                        else:
                            b, c = right[node], left[node]
                            left[p], right[g], right[node], left[node] = b, c, p, g
                        up[p] = up[g] = node
                        if b:
                            up[b] = p
                        if c:
                            up[c] = g
                    if above:
                        if left[above] == g:
                            left[above] = node
                        elif right[above] == g:
                            right[above] = node
                    up[node] = p = above
                else:
                    top = p
                    if left[p] == node:
                        c = right[node]
                        left[p], right[node] = c, p
                    else:
                        c = left[node]
                        right[p], left[node] = c, p
                    if c:
                        up[c] = p
                    up[p], up[node] = node, g
                    p = 0
            when = seen[top]
            gap = now - when
            if when >= 0 and gap <= length[node]:
                found[now - gap - length[node] + 1, gap] = now
            cut = right[node]
            if cut:
                seen[cut] = when
            right[node] = below
            below, node = node, up[node]
        seen[below] = now
    return found


def _stretches(codes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Stretches (start, end exclusive) of words that windows of ``window`` words cover which occur twice or more.

    Every window inside a run occurs once more inside it, so a run and the words that would extend it lie in one stretch.
    Equal hashes of unequal windows only make stretches longer.
    """
    n = len(codes) - window + 1
    if n < 2:
        return []
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0x100000001B3) + mixed[k : k + n]
    order = np.argsort(hashes)
    ranked = hashes[order]
    twice = np.zeros(n, bool)
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    twice[order[same]] = twice[order[same + 1]] = True
    cover = np.zeros(len(codes) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    held = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
    edges = np.diff(held)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def runs_of(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words, by start and then period; at least two periods each."""
    window = max(1, least_words - 2 * least_words // least_periods + 1)
    number = dict(zip(dict.fromkeys(words), count()))
    if len(words) < least_words or len(words) - len(number) < least_words // least_periods:  # too few repeats for any run
        return []
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = []
    for start, end in _stretches(codes, window):
        if end - start >= least_words:
            for (s, period), last in squares(codes[start:end].tolist()).items():
                size = last - s + 1
                if size >= least_words and size >= least_periods * period:
                    out.append((start + s, size, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words), bool)
    for start, size, period in runs:
        dropped[start + period : start + size] = True
    return [w for w, d in zip(words, dropped.tolist(), strict=True) if not d]


def periodic_runs(docs: DataFrame, text: Column | str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id``, ``runs`` (structs of start, length and period in words, by start and then period) and ``collapsed``
    (the words that no run holds after its first period, joined by one space), one row per row of ``docs``.

    Whole texts are read, of any length: memory grows with the words of one text that lie in repeated passages. A null text
    is empty; fewer words than ``least_words`` have no run. Repeated rows give repeated rows; other columns are ignored; a null
    doc_id stays null; the empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, kept = [], []
                for raw in part.column(1).to_pylist():
                    words = (raw or b"").split()
                    own = runs_of(words, least_words, least_periods)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    kept.append(b" ".join(without_repeats(words, own)))
                run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, run), pa.array(kept, pa.binary())], ["doc_id", "runs", "collapsed"])

    source = docs.select("doc_id", (F.col(text) if isinstance(text, str) else text).cast("binary").alias("raw"))
    found = source.mapInArrow(rows, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
