"""Benchmark passages in documents: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are pairs of words, and a place is aligned wherever the seeds leave a score of ``threshold`` possible, so the
result is that of aligning every item with every document. Let an alignment of an item of L words match m of
them and reach ``2 * threshold * L`` points. Words left out, replaced or put in cost one point each, ``2 * m - 2 *
threshold * L`` in all at most, and no more than L - m words of the item can be left out or replaced. So at least
``(4 * threshold - 1) / 3 * L - 1`` neighbours of the item are matched as neighbours or with one word put in between, and the
alignment covers at most ``(3 - 2 * threshold) * L`` words of the document. An item for which this is no
more than 0 also has seeds from words with one between; any of more than ``1 / threshold`` words then has a seed in
every such alignment, because without one each further match costs the two points that it brings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import free_name, mixed, texts

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Shorter items have no rows.
LEAST_WORDS = 3
#: Points of an equal word, of another word, and of a word left out on either side.
EQUAL, OTHER, GAP = 2, -1, -1
#: Share of an item's best possible score from which a document counts as contaminated.
THRESHOLD = 0.4
#: Items that travel to the tasks at a time; a larger benchmark takes more passes.
BLOCK_ITEMS = 20_000


def words(text: str) -> np.ndarray:
    """Hashes of the words; case, marks and white space don't count."""
    found = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    return np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))


def neighbours(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word and the next."""
    return mixed(hashes[:-1], hashes[1:])


def jumps(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word and the next but one."""
    return mixed(hashes[:-2], hashes[2:])


def pairs(hashes: np.ndarray) -> np.ndarray:
    """What a document can match seeds with: neighbours, then words with one between."""
    return np.concatenate([neighbours(hashes), jumps(hashes)])


def least_hits(length: int, threshold: float) -> int:
    """How many neighbours of an item every alignment that reaches the threshold has; 0: maybe none."""
    return max(0, int(np.ceil((4 * threshold - 1) / 3 * length - 1 - 1e-9)))


def seeds(item: np.ndarray, threshold: float) -> np.ndarray:
    """The hashes by which an item is found in documents."""
    if len(item) < LEAST_WORDS:
        return item[:0]
    return neighbours(item) if least_hits(len(item), threshold) else pairs(item)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment of an item in a window: (score, place of its last word in the window)."""
    steps = np.arange(len(window) + 1) * -GAP
    row = np.zeros(len(window) + 1, dtype=np.int64)
    best, at = 0, 0
    for word in item:
        here = np.maximum(row + GAP, 0)
        here[1:] = np.maximum(here[1:], row[:-1] + np.where(window == word, EQUAL, OTHER))
        # A gap in the item: the best of all places before, less what the words between cost.
        row = np.maximum.accumulate(here + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, at = int(row[k]), k
    return best, at


class SeedIndex:
    """Which items have a seed, and how many seeds in how many words of a text make an alignment worthwhile.

    Sorted arrays that are small enough to travel to every task.
    """

    def __init__(self, hashes: np.ndarray, items: np.ndarray, least: np.ndarray, spans: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.least, self.spans = hashes[order], items[order], least, spans

    def maybe(self) -> np.ndarray:
        """Which 16-bit prefixes of hashes occur: most words of a text are ruled out by this."""
        flags = np.zeros(1 << 16, dtype=bool)
        flags[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        return flags

    def hits(self, hashes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, item) of all seeds of a text, by item and place."""
        found = pairs(hashes)
        at = np.flatnonzero(flags[(found >> np.uint64(48)).astype(np.int64)])
        left = np.searchsorted(self.hashes, found[at], "left")
        count = np.searchsorted(self.hashes, found[at], "right") - left
        at, left, count = at[count > 0], left[count > 0], count[count > 0]
        entry = np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else left
        at = np.where(at < len(hashes) - 1, at, at - (len(hashes) - 1))
        at, item = np.repeat(at, count), self.items[entry]
        order = np.lexsort((at, item))
        return at[order], item[order]

    def windows(self, hashes: np.ndarray, flags: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): the parts of a text that alignments which reach the threshold lie in, by item and place."""
        at, item = self.hits(hashes, flags)
        first = np.arange(len(at))
        last = first + self.least[item] - 1
        first, last = first[last < len(at)], last[last < len(at)]
        near = (item[first] == item[last]) & (at[last] - at[first] <= self.spans[item[first]])
        owner, low, high = item[first[near]], at[first[near]], at[last[near]]
        # Hits nearer than a span go to one window.
        split = np.flatnonzero((np.diff(owner) != 0) | (low[1:] - high[:-1] > self.spans[owner[1:]])) + 1
        for group in np.split(np.arange(len(owner)), split) if len(owner) else []:
            k = int(owner[group[0]])
            span = int(self.spans[k])
            yield k, max(0, int(low[group[0]]) - span), int(high[group[-1]]) + span + 2


def _frequencies(docs: DataFrame, known: np.ndarray) -> dict[int, int]:
    """In how many documents each seed of a block of items occurs, over all documents."""
    known = np.unique(known)
    flags = np.zeros(1 << 16, dtype=bool)
    flags[(known >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = pairs(words(text))
                found = np.unique(found[flags[(found >> np.uint64(48)).astype(np.int64)]])
                if len(found) and len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    counts[at[known[at] == found]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["seed", "n"])

    counted = texts(docs).select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {int(known[r["seed"]]): r["n"] for r in counted.toLocalIterator()}  # at most the seeds of a block


def rare_seeds(items: list[np.ndarray], frequency: dict[int, int], threshold: float) -> SeedIndex:
    """The seeds of every item that occur in documents, but for some of the most frequent.

    Every seed that is dropped lowers the number of hits that an item needs by one, and no more than half
    of that number are dropped, so no window is lost. Rarity is ranked within the item.
    """
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    least, spans = np.ones(len(items), np.int64), np.zeros(len(items), np.int64)
    for k, item in enumerate(items):
        found = seeds(item, threshold)
        often = np.array([frequency.get(int(s), 0) for s in found], dtype=np.int64)
        needed = max(1, least_hits(len(item), threshold))
        dropped = needed // 2
        keep = np.argsort(often, kind="stable")[: len(found) - dropped]
        keep = keep[often[keep] > 0]
        hashes.append(found[keep])
        owners.append(np.full(len(keep), k))
        least[k], spans[k] = needed - dropped, int(np.ceil((3 - 2 * threshold) * len(item)))
    return SeedIndex(np.concatenate(hashes), np.concatenate(owners), least, spans)


def find_items(text: str, items: list[np.ndarray], index: SeedIndex, flags: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
    """(item, score, last word) of the items that a text holds, by item."""
    hashes = words(text)
    best: dict[int, tuple[int, int]] = {}
    for k, low, high in index.windows(hashes, flags):
        score, last = align(items[k], hashes[low:high])
        if score > best.get(k, (0, 0))[0]:
            best[k] = score, low + last
    full = {k: EQUAL * len(items[k]) for k in best}
    return [(k, score / full[k], end) for k, (score, end) in best.items() if score >= threshold * full[k]]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    count = rows.count()
    blocks = max(1, -(-count // BLOCK_ITEMS))
    for b in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in block], [words(r["text"]) for r in block]


def matcher(docs: DataFrame, ids: list[int | None], items: list[np.ndarray], threshold: float):
    """A column function: the items of one block that a whole text holds."""
    known = np.concatenate([np.zeros(0, np.uint64), *[seeds(i, threshold) for i in items]])
    index = rare_seeds(items, _frequencies(docs, known), threshold)
    flags = index.maybe()

    def match(series):
        return series.map(
            lambda t: [{"item_id": ids[k], "score": s, "last_word": e} for k, s, e in find_items(t, items, index, flags, threshold)]
        )

    return F.pandas_udf(match, "array<struct<item_id:long,score:double,last_word:long>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, score, last_word.

    ``score`` is the item's best local alignment in the document as a share of a perfect one; exact copies have 1.
    A window is aligned where so many of the item's rare seeds (pairs of words, ranked by the number of
    documents that have them) are close together that it could reach the threshold. The benchmark goes to the tasks in blocks
    of ``BLOCK_ITEMS`` items, so its size has no limit; texts are never shuffled. Items of fewer
    than three words have no seeds and no rows, as have null and empty texts. Repeated documents
    give repeated rows, repeated items one.
    """
    rows = texts(docs)
    parts = []
    for ids, items in _blocks(benchmark):
        match = matcher(docs, ids, items, threshold)
        parts.append(rows.select("doc_id", F.explode(match(F.col("text"))).alias("m")).select("doc_id", "m.*"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; no shuffle."""
    for ids, items in _blocks(benchmark):
        name = free_name(docs, "matches")
        match = matcher(docs, ids, items, threshold)
        docs = docs.withColumn(name, match(F.coalesce(F.col("text"), F.lit("")))).filter(F.size(F.col(name)) == 0).drop(name)
    return docs
