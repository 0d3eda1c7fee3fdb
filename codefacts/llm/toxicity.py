"""Toxicity classifier that identity terms do not move.

A logistic regression over the words of a text and their beginnings (inflected insults share a stem). Besides the labels it is trained on counterfactuals: in labelled
sentences the identity terms are swapped for others of their group, and a change of the score is penalised. A group that is
often the target of insults then carries no weight of its own, so neutral mentions of it are not rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.compression import sampled
from codefacts.llm.order_minhash import shingles, word_codes

#: Labelled rows of either label, and characters of one text, that are fitted on at most.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 20_000
#: Words with a weight, at most; the strength of evidence they need, in standard errors.
VOCABULARY = 2_000
LEAST_Z = 4.5
PREFIXES = (4, 5, 6)
#: What the toxic rows weigh together in the fit; under one half, so that without evidence nothing is rejected.
TOXIC_SHARE = 0.4
PENALTY = 10.0

# Terms of one group are swapped in a ring.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"), ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"), ("immigrant", "refugee", "citizen", "foreigner"),
    ("american", "mexican", "chinese", "african", "european", "arab", "indian"), ("deaf", "blind", "disabled", "autistic"), ("old", "young", "elderly"),
)
SWAP = {t: ring[(i + 1) % len(ring)] for ring in IDENTITY for i, t in enumerate(ring)}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer words, marked by a star."""
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def distinct(examples: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The examples that are no near copies of an earlier one with the same label.

    Copies of one labelled text would make its chance words look like evidence. Two texts count as copies when both
    of two minima over their five-word shingles agree, in one of eight tries.
    """
    seen, out = set(), []
    for label, text in examples:
        runs = shingles(word_codes(text.encode("utf-8", "surrogatepass").split()))
        least = [int((runs * np.uint64(k * 0x9E3779B97F4A7C15 % 2**64 | 1)).min()) for k in range(1, 17)] if len(runs) else [0] * 16
        keys = {(label, j, *least[j : j + 2]) for j in range(0, 16, 2)}
        if not keys & seen:
            out.append((label, text))
        seen |= keys
    return out


def counterfactuals(text: str) -> list[set[str]]:
    """The words of ``text`` with the identity terms of one sentence swapped, for each sentence that has any."""
    sentences = [WORD.findall(s) for s in SENTENCE.split((text or "").lower())]
    held = Counter(w for s in sentences for w in set(s))
    out = []
    for s in sentences:
        terms = {w for w in s if w in SWAP}
        if terms:
            out.append(({w for w in held if w not in terms or held[w] > 1}) | {SWAP[w] for w in terms})
    return out


def fit(examples: list[tuple[int, str]], penalty: float = PENALTY, steps: int = 400) -> dict[str, float]:
    """Word weights and the constant (under the empty word); without both labels the constant alone.

    The labels weigh TOXIC_SHARE and the rest, however many rows have them. ``penalty`` weighs the mean squared change of the linear score under swaps.
    """
    examples = distinct(examples)
    numbers: dict[str, int] = {}  # features as numbers, so that each is held once
    number = lambda words: np.array(sorted({numbers.setdefault(w, len(numbers)) for w in features_of(words)}), np.int32)
    rows = [number(words_of(t)) for _, t in examples]
    y = np.array([v for v, _ in examples], float)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return {"": math.log(TOXIC_SHARE / (1 - TOXIC_SHARE))}
    swaps = [(i, number(c)) for i, (_, t) in enumerate(examples) for c in counterfactuals(t)]
    names = list(numbers)
    seen = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == c]), minlength=len(names)) for c in (0, 1)]
    strength = {}  # signed root of the likelihood ratio against equal shares under both labels
    for f in np.flatnonzero(seen[0] + seen[1] >= 5).tolist():
        a, b = int(seen[1][f]), int(seen[0][f])
        both = (a + b) / (n1 + n0)
        if both < 1:
            ratio = sum(k * math.log(k / n / e) for k, n, e in ((a, n1, both), (b, n0, both), (n1 - a, n1, 1 - both), (n0 - b, n0, 1 - both)) if k)
            strength[f] = math.sqrt(max(0.0, 2 * ratio)) * (1 if a * n0 > b * n1 else -1)
    chosen = sorted((f for f in strength if abs(strength[f]) >= LEAST_Z), key=lambda f: (-abs(strength[f]), names[f]))[:VOCABULARY]
    moved = [(np.setdiff1d(c, rows[i]), np.setdiff1d(rows[i], c)) for i, c in swaps]
    chosen = sorted({*chosen, *(f for pair in moved for part in pair for f in part.tolist() if f in strength)}, key=lambda f: names[f])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    width = len(chosen) + 1

    # sparse rows: (row, column, value) of every entry; the last column is the constant
    def entries(parts: list[tuple[int, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([np.full(len(f), i) for i, f, _ in parts] or [np.zeros(0, int)])
        column = np.concatenate([place[f] for _, f, _ in parts] or [np.zeros(0, int)])
        value = np.concatenate([np.full(len(f), v) for _, f, v in parts] or [np.zeros(0)])
        held = column >= 0
        return at[held], column[held], value[held]

    forward = lambda m, n, w: np.bincount(m[0], m[2] * w[m[1]], n)
    back = lambda m, v: np.bincount(m[1], m[2] * v[m[0]], width)
    x = entries([(i, r, 1.0) for i, r in enumerate(rows)])
    change = entries([(i, f, v) for i, (more, less) in enumerate(moved) for f, v in ((more, 1.0), (less, -1.0))])
    share = np.where(y == 1, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / n0)
    w, speed = np.zeros(width), np.zeros(width)
    # steps stay below the inverse of the steepest curvature of the penalty
    steepest = penalty * float(np.bincount(change[0], change[2] ** 2).max(initial=0.0)) if moved else 0.0
    rate = 4.0 / (1.0 + steepest)
    for _ in range(steps * 4 if moved else steps):
        p = 1 / (1 + np.exp(-np.clip(forward(x, len(rows), w) + w[-1], -30, 30)))
        slope = back(x, share * (p - y)) + 1e-4 * np.append(w[:-1], 0)
        slope[-1] += (share * (p - y)).sum()
        if moved:
            slope = slope + penalty * back(change, forward(change, len(moved), w)) / len(moved)
        speed = 0.8 * speed - rate * 0.2 * slope
        w = w + speed
    return {**{names[f]: float(v) for f, v in zip(chosen, w[:-1], strict=True)}, "": float(w[-1])}


def scored(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: toxic) and ``predicted``, one row per row of ``docs``.

    Whole texts are read; a null text is empty and has the score of the constant. Repeated rows score alike; other columns
    are no inputs; the empty table gives no rows.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, base = weights.keys() - {""}, weights[""]
        for frame in frames:
            x = np.array([base + sum(weights[w] for w in sorted(known & features_of(words_of(t)))) for t in frame["text"]], float)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": 1 / (1 + np.exp(-np.clip(x, -30, 30)))})

    found = docs.select("doc_id", "text").mapInPandas(rows, "doc_id bigint, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fitted(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic") -> dict[str, float]:
    """Weights from the labelled rows where ``train`` (a condition on doc_id) holds."""
    return fit(sampled(docs, labels, label, train, SAMPLE_ROWS, SAMPLE_CHARS))


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic") -> DataFrame:
    return scored(docs, fitted(docs, labels, train, label))


def without_toxic(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns and repeated rows kept."""

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, base = weights.keys() - {""}, weights[""]
        for batch in texts:
            yield pd.Series([base + sum(weights[w] for w in sorted(known & features_of(words_of(t)))) < 0 for t in batch], dtype=bool)

    return docs.where(F.pandas_udf(judge, "boolean")("text"))
