"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import fold, free_name, labelled, per_batch, saved, texts

WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")
BITS = 20
#: FTRL-proximal: step, offset of the per-coordinate rates, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 0.1
#: Labelled rows to learn from, rows of one learner, and rows it sees in all its rounds.
SAMPLE_ROWS, LEARNER_ROWS, SEEN_ROWS = 20_000, 5_000, 40_000


def slots(text: str) -> np.ndarray:
    """Slots of the words, their stems, word pairs and pairs with one word between, each occurrence.

    The stems are the first four and five bytes: compound words of one root have little else in common.
    """
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())

    def hashed(parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, parts), dtype=np.uint64, count=len(parts))

    hashes = hashed(words)
    kinds = [
        hashes * np.uint64(0x9E3779B97F4A7C15),
        hashed([w[:4] for w in words]) * np.uint64(0x8EBC6AF09C88C6E3),
        hashed([w[:5] for w in words]) * np.uint64(0x589965CC75374CC3),
        hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:] * np.uint64(0x165667B19E3779F9),
        hashes[:-2] * np.uint64(0xD6E8FEB86659FD93) + hashes[2:] * np.uint64(0xA0761D6478BD642F),
    ]
    mixed = np.concatenate(kinds)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


class Ftrl:
    """Weights with a rate of their own; most stay zero under the L1 penalty. Slot ``1 << BITS`` is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = weight * (p - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of the model, the bias last.

    The bounded sample of labelled rows (``rows``, a parameter) is split by document over learners of
    about ``LEARNER_ROWS`` rows that pass several times over their part; the model is the mean of their weights. Only the sample's
    keys and the nonzero weights (at most 2**20) pass through the driver's memory. Without labelled
    rows there are no weights.
    """
    sample = saved(labelled(labels, "toxic", rows, fold("doc_id", 3) != 1), "toxic-labels")
    learners = max(1, sample.count() // LEARNER_ROWS)
    chosen = texts(docs).join(F.broadcast(sample), "doc_id")  # at most ``rows`` pairs of numbers

    def to_slots(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = [np.append(np.unique(slots(t)), np.uint64(1 << BITS)).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(blobs, pa.binary()), batch.column(2)], ["doc_id", "slots", "label"]
        )

    examples = chosen.select("doc_id", "text", "label").mapInArrow(per_batch(to_slots), "doc_id long, slots binary, label int")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "slots"])
        part = part.iloc[np.random.default_rng(42).permutation(len(part))]
        positive = max(1, int((part["label"] == 1).sum()))
        boost = float(np.clip((len(part) - positive) / positive, 1.0, 4.0))
        model = Ftrl()
        made = [(np.frombuffer(b, "<u4"), int(y)) for b, y in zip(part["slots"], part["label"], strict=True)]
        for _ in range(min(16, max(4, SEEN_ROWS // len(made)))):
            for at, label in made:
                model.learn(at, label, boost if label else 1.0)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "weight": w[at]})

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(learners))
    learned = examples.withColumn("shard", shard).groupBy("shard").applyInPandas(learn, "slot long, weight double")
    mean = learned.groupBy("slot").agg((F.sum("weight") / learners).alias("weight")).toPandas().sort_values("slot")
    return mean["slot"].to_numpy(np.int64), mean["weight"].to_numpy(np.float64)


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """A column function: score of a whole text in 0 to 1 (higher: likelier toxic).

    Every distinct feature counts once. A text without words (null and empty ones too) gets the score of the bias
    alone, a model without weights gives 0.5.
    """
    at, found_weights = model[0].astype(np.int32), model[1].astype(np.float32)  # at most 2**20 of each
    ready: list[np.ndarray] = []

    def one(text: str) -> float:
        dense = ready[0]
        found = slots(text)
        known = found[dense[found] != 0]
        return float(dense[-1]) + float(dense[np.unique(known)].sum())

    def score(series):
        if not ready:
            ready.append(np.zeros((1 << BITS) + 1, dtype=np.float32))
            ready[0][at] = found_weights
        total = series.map(one).astype("float64")
        return 1.0 / (1.0 + np.exp(-total.clip(-35, 35)))

    return F.pandas_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score all documents with a model learned from the labelled ones that aren't held out.

    One row per document: doc_id, held_out, score, predicted (1 from the threshold on). No documents give no rows.
    """
    scored = texts(docs).select("doc_id", scorer(fit(docs, labels))(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold with all their columns; no shuffle of texts."""
    name = free_name(docs, "toxicity")
    scored = docs.withColumn(name, scorer(fit(docs, labels))(F.coalesce(F.col("text"), F.lit(""))))
    return scored.filter(F.col(name) < threshold).drop(name)
