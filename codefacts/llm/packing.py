"""Lexical retrieval packing: every window of tokens holds a seed document and its BM25 neighbours.

Documents are dealt to shards of bounded size, with more shards as the corpus grows. Each shard builds an inverted index with BM25 weights. A
window starts with the first unused document; unused neighbours by score fill it, the last one is cut and its rest opens the
next window. So only the last window of a shard has padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.tokens import TOKENIZER, default_path, encode

WINDOW = 2048
#: Tokens of a shard, about; and of a segment: longer documents are dealt in segments of this length.
SHARD_TOKENS = 600_000
SEGMENT = 32 * WINDOW
END = 1
__all__ = ["TOKENIZER", "WINDOW", "encode", "fill", "neighbours", "packed"]


def _segments(path: str):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at : at + 64]
                out = []
                for doc_id, ids in zip(part["doc_id"], encode([t or "" for t in part["text"]], path), strict=True):
                    ids = np.append(ids, np.uint16(END))
                    for s in range(0, len(ids), SEGMENT):
                        own = ids[s : s + SEGMENT].tobytes()
                        out.append((doc_id, s, len(ids), zlib.crc32(own, s), own))
                yield pd.DataFrame(out, columns=["doc_id", "start", "doc_tokens", "deal", "ids"])

    return rows


def neighbours(docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, common: float = 0.25):
    """Inverted index with BM25 weights over ``docs``; returns a function from a document to the scores of all.

    Terms that more than the share ``common`` of the documents hold are stop words: they tell no neighbours apart.
    """
    n = len(docs)
    terms, counts = zip(*[np.unique(d, return_counts=True) for d in docs], strict=True)
    width = max((int(t[-1]) for t in terms if len(t)), default=0) + 1
    owner = np.repeat(np.arange(n), [len(t) for t in terms])
    term, count = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
    lengths = np.array([len(d) for d in docs], np.float32)
    held = np.bincount(term, minlength=width)
    told = held[term] <= max(1, common * n)
    owner, term, count = owner[told], term[told], count[told]
    terms = np.split(term, np.cumsum(np.bincount(owner, minlength=n))[:-1])
    held = np.bincount(term, minlength=width)
    idf = np.log1p((n - held + 0.5) / (held + 0.5)).astype(np.float32)
    weight = idf[term] * count * (k1 + 1) / (count + k1 * (1 - b + b * lengths[owner] / max(lengths.mean(), 1)))
    order = np.argsort(term, kind="stable")
    owner, weight = owner[order], weight[order]
    begin = np.concatenate([[0], np.cumsum(held)])

    def scores(i: int) -> np.ndarray:
        own = terms[i]
        size = held[own]
        at = np.repeat(begin[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(owner[at], weights=weight[at], minlength=n)

    return scores


def fill(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill windows one after the other.

    The next document is always the unused one with the highest score for the seed of the window; without a common
    term the first unused one. A document cut at the end of a window seeds the next.
    """
    if not docs:
        return []
    scores = neighbours(docs)
    used = np.zeros(len(docs), bool)
    pieces, sequence, room, first = [], 0, window, 0
    current, start, queue = 0, 0, None
    used[0] = True
    while True:
        take = min(room, len(docs[current]) - start)
        pieces.append((current, start, take, sequence, window - room))
        room, start = room - take, start + take
        if room == 0:
            sequence, room, queue = sequence + 1, window, None
        if start < len(docs[current]):
            continue
        while first < len(docs) and used[first]:
            first += 1
        if first == len(docs):
            return pieces
        if room == window:
            current = first
        else:
            if queue is None:  # neighbours of the document that opened this window, best first
                seed = next(p[0] for p in reversed(pieces) if p[3] == sequence and p[4] == 0)
                score = scores(seed)
                score[used] = -1
                queue = iter(np.argsort(-score, kind="stable").tolist())
            current = next(i for i in queue if not used[i])
        used[current], start = True, 0


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "start", "deal"], kind="stable").reset_index(drop=True)
    docs = [np.frombuffer(x, np.uint16) for x in frame["ids"]]
    pieces = pd.DataFrame(fill(docs), columns=["at", "from", "length", "sequence", "offset"])
    row = frame.iloc[pieces["at"]].reset_index(drop=True)
    crc = [zlib.crc32(docs[a][s : s + n].astype("<u4").tobytes()) for a, s, n in zip(pieces["at"], pieces["from"], pieces["length"], strict=True)]
    return pd.DataFrame({
        "doc_id": row["doc_id"], "start": row["start"] + pieces["from"], "length": pieces["length"], "ids_crc32": crc, "doc_tokens": row["doc_tokens"],
        "sequence_id": row["shard"] * 2**32 + pieces["sequence"], "offset": pieces["offset"]})


def packed(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents in sequences of at most WINDOW ids, see the columns of ``_packed``.

    One row per piece; every id of every row lies in one piece. A null text is empty and is its END id alone; repeated
    rows are packed each; a null doc_id stays null; other columns are ignored. The empty table gives no rows. Shards
    follow the number of characters, so a shard stays near ``shard_tokens`` at any size; rows are dealt by a hash of their ids.
    """
    tokenizer = tokenizer or default_path()
    total = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 8)).first()[0] or 0
    shards = max(1, math.ceil(total / 2.5 / shard_tokens))
    segments = docs.select("doc_id", "text").mapInPandas(_segments(tokenizer), "doc_id bigint, start bigint, doc_tokens bigint, deal bigint, ids binary")
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "deal"), F.lit(shards)))
    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("shard").applyInPandas(_packed, out)
