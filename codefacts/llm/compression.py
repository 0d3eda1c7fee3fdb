"""Quality classifier by compression: which labelled text makes a document cheaper to write down.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut into blocks that are
compressed with either dictionary; the difference of the two sizes over their sum, with the size under the
better dictionary against the plain size, is calibrated to a probability by logistic regression on labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import text_or_empty

#: Labelled rows that are fitted on, of either label at most; characters of a row's text in the sample at most.
SAMPLE_ROWS = 1_500
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 32_768
BLOCK = 1_024
FEATURES = 3


class Models:
    """The two dictionaries and the calibration; small, so tasks get a copy."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights
        self._tools = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_tools": None}

    def features(self, text: str | None) -> list[float]:
        """Mean over the text of the normalised size difference, of the better size per byte, and 1. Empty: 0, 0, 1."""
        if self._tools is None:
            tool = lambda raw: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False).compress
            self._tools = tool(self.good), tool(self.bad)
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return [0.0, 0.0, 1.0]
        good = bad = 0
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            good += len(self._tools[0](block))
            bad += len(self._tools[1](block))
        return [20 * (bad - good) / (bad + good), 2 * min(good, bad) / len(raw), 1.0]

    def score(self, text: str | None) -> float:
        x = float(np.dot(self.features(text), self.weights))
        return 1 / (1 + float(np.exp(-np.clip(x, -30, 30))))


def _dictionary(texts: list[str]) -> bytes:
    samples = [b for t in texts for raw in [t.encode("utf-8", "surrogatepass")] for b in (raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK))]
    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the text itself is the dictionary
        return whole[-DICTIONARY_BYTES:]


def calibrated(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with both labels weighing the same, by Newton steps."""
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + penalty * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
    return w


def sampled(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, chars: int) -> list[tuple[int, str]]:
    """At most ``rows`` labelled texts of either label, chosen by a hash of their id; only ``train`` rows.

    The documented bound of the fit: 2 * rows * chars characters reach the driver; of a longer text the fit sees
    ``chars`` characters. Scoring reads whole texts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # at most 2 * rows ids
    text = F.substring(text_or_empty(), 1, chars)
    found = docs.select("doc_id", text.alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return [(r["y"], r["text"]) for r in found.orderBy("doc_id").collect()]


def fit(examples: list[tuple[int, str]]) -> Models:
    """Dictionaries from two thirds of the examples, calibration from the rest.

    Without examples of both labels there is nothing to learn: every score is then one half.
    """
    part = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 for _, t in examples]
    good = [t for (y, t), p in zip(examples, part, strict=True) if y == 1 and p]
    bad = [t for (y, t), p in zip(examples, part, strict=True) if y == 0 and p]
    if not good or not bad:
        return Models(b"", b"", [0.0] * FEATURES)
    models = Models(_dictionary(good), _dictionary(bad), [0.0] * FEATURES)
    rest = [e for e, p in zip(examples, part, strict=True) if not p] or examples
    if len({y for y, _ in rest}) < 2:
        rest = examples
    models.weights = calibrated(np.array([models.features(t) for _, t in rest]), np.array([y for y, _ in rest], float)).tolist()
    return models


def scored(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: good) and ``predicted``, one row per row of ``docs``.

    Whole texts are read; a null text counts as empty and has the score of the calibration's constant. Repeated rows
    score alike; other columns are no inputs; the empty table gives no rows.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [models.score(t) for t in frame["text"]]})

    found = docs.select("doc_id", "text").mapInPandas(rows, "doc_id bigint, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> DataFrame:
    """Fits on the labelled rows where ``train`` (a condition on doc_id) holds and scores all ``docs``."""
    return scored(docs, fit(sampled(docs, labels, label, train, SAMPLE_ROWS, SAMPLE_CHARS)))
