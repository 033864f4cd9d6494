"""Quality by importance resampling: how much likelier a target model makes a text than a raw one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import free_name, labelled, saved, texts

BITS = 14
SAMPLE_ROWS = 20_000
#: Characters by class, so that the run of classes is the shape of a word: letters, capitals, digits.
SHAPES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
RUNS = re.compile(rb"(.)\1+", re.DOTALL)
SAME = np.uint64(0x5BF03635)


def features(text: str) -> np.ndarray:
    """Buckets of the words, word pairs (a repeated word is one pair whatever the word) and triples of word shapes."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    shapes = RUNS.sub(rb"\1", data.translate(SHAPES)).split()

    def hashed(parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, parts), dtype=np.uint64, count=len(parts))

    w, s = hashed(words), hashed(shapes)
    pairs = np.where(w[:-1] == w[1:], SAME, w[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[1:])
    triples = (s[:-2] * np.uint64(0xD6E8FEB86659FD93) + s[1:-1]) * np.uint64(0xA0761D6478BD642F) + s[2:]
    mixed = np.concatenate([w * np.uint64(0x9E3779B97F4A7C15), pairs, s * np.uint64(0x8EBC6AF09C88C6E3), triples])
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


class Model:
    """Log ratios of the target's to the raw model's bucket probabilities, and the cut of the sampling key."""

    def __init__(self, ratios: np.ndarray, cut: float) -> None:
        self.ratios, self.cut = ratios.astype(np.float32), cut


def bucket_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(bucket, raw, target): counts over all documents, and over the labelled good ones of the sample.

    Each task adds up its own documents and emits one row per bucket, so at most 2**14 rows per task are shuffled.
    """
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(features(text).astype(np.int64), minlength=size)
                raw += found
                if label == 1:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    rows = texts(docs).join(F.broadcast(sample), "doc_id", "left").select("text", "label")
    counts = rows.mapInArrow(run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_ratios(counts: DataFrame) -> np.ndarray:
    """Log ratio per bucket, both models smoothed by one count per bucket."""
    size = 1 << BITS
    raw, target = np.ones(size), np.ones(size)
    for row in counts.toLocalIterator():  # at most 2**14 rows
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if target.sum() == size:
        return np.zeros(size)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigher(ratios: np.ndarray):
    """A column function: log importance weight of a whole text, the sum of its features' log ratios."""
    ratios = ratios.astype(np.float32)

    def weigh(series):
        return series.map(lambda t: float(ratios[features(t)].sum(dtype=np.float64))).astype("float64")

    return F.pandas_udf(weigh, "double")


def gumbel(key: F.Column, seed: int = 42) -> F.Column:
    """Gumbel noise that depends on the key alone, so every run draws the same."""
    uniform = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def weights(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, log_weight, sample_key (the weight with Gumbel noise)."""
    rows = texts(docs, key, text)
    weighed = rows.select("doc_id", weigher(ratios)(F.col("text")).alias("log_weight"))
    return weighed.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id")))


def best_cut(keys: np.ndarray, good: np.ndarray) -> float:
    """The cut between good and other labelled rows with the least errors, in the middle of the widest such gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order]
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    at = [i for i in np.flatnonzero(errors == errors.min()) if 0 < i < len(keys)]
    if not at:
        return -np.inf if errors[0] <= errors[-1] else np.inf
    i = max(at, key=lambda i: keys[i] - keys[i - 1])
    return float((keys[i] + keys[i - 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Both models and the cut.

    The target model learns from the good rows of a bounded sample of the labels (``rows``, a parameter), the
    raw model from all documents. The cut is the one that parts good from other rows of the
    sample best: with it, k of the top-k sampling is the number of documents that look like good ones.
    Without labels of both kinds everything is kept.
    """
    sample = saved(labelled(labels, "quality", rows), "quality-labels")
    ratios = fit_ratios(bucket_counts(docs, sample))
    chosen = texts(docs).join(F.broadcast(sample), "doc_id")
    known = weights(chosen, ratios).join(F.broadcast(sample), "doc_id").select("sample_key", "label").toPandas()
    return Model(ratios, best_cut(known["sample_key"].to_numpy(np.float64), known["label"].to_numpy() == 1))


def sample_by_importance(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, log_weight, sample_key, selected.

    Selected are the k documents with the largest keys, k being the number of keys from the cut on: the
    Gumbel noise makes this a sample without replacement in proportion to the weights. Null and empty
    texts have weight 0. Repeated rows of one doc_id draw the same noise. No documents give no rows.
    """
    model = fit(docs, labels)
    return weights(docs, model.ratios).withColumn("selected", F.col("sample_key") >= model.cut)


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected documents with all their columns; no shuffle."""
    model = fit(docs, labels)
    name = free_name(docs, "log_weight")
    weighed = docs.withColumn(name, weigher(model.ratios)(F.coalesce(F.col("text"), F.lit(""))))
    return weighed.filter(F.col(name) + gumbel(F.col("doc_id").cast("long")) >= model.cut).drop(name)


def top_k(weighed: DataFrame, k: int, bins: int = 1000) -> DataFrame:
    """Exactly the ``k`` rows with the largest ``sample_key`` (all rows if there are fewer); ties by doc_id, then at will.

    The k-th largest key is found by counting rows per bin and looking into the bin it lies in, again
    and again: each pass brings at most ``bins`` counts to the driver, and no task sorts all rows.
    """
    rows = saved(weighed, "weighed")
    low, high, total = rows.agg(F.min("sample_key"), F.max("sample_key"), F.count("sample_key")).first()
    if k >= total:
        return rows
    if k <= 0:
        return rows.limit(0)
    above = 0
    while True:
        width = (high - low) / bins
        if low + width <= low:
            break
        at = F.least(F.floor((F.col("sample_key") - low) / width), F.lit(bins - 1))
        inside = rows.filter((F.col("sample_key") >= low) & (F.col("sample_key") <= high))
        counts = {r["at"]: r for r in inside.groupBy(at.alias("at")).agg(
            F.count("*").alias("n"), F.min("sample_key").alias("low"), F.max("sample_key").alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b]["n"] >= k:
                low, high = counts[b]["low"], counts[b]["high"]
                break
            above += counts[b]["n"]
        if low == high or len(counts) == 1:
            break
    tied = rows.filter((F.col("sample_key") >= low) & (F.col("sample_key") <= high))
    return rows.filter(F.col("sample_key") > high).unionByName(
        tied.orderBy(F.desc("sample_key"), "doc_id").limit(k - above)
    )
