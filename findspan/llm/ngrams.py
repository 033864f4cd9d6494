"""Language-model scoring: smoothed n-grams as a weighted automaton with failure arcs, over a corpus of any size.

The model is never gathered. Texts become chunks of about a million tokens. A chunk asks for its own n-grams: their
hashes, sorted and cut into ranges, go to one task per range, which adds up the training counts of
all chunks and answers each in the order it asked. A few chunks ask together, so an n-gram that several of them have travels once. With the answers a chunk builds the part of the
automaton that its texts can visit: states, the arcs that leave them, their failure arcs and weights. All texts of the chunk then go through
it from left to right, each with its own state. Everything rests on the counts of the whole corpus, so neither
chunks nor partitions change a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import fold, mixed, saved, texts

CHUNK_TOKENS = 1 << 20
#: Hashes that one task adds up at a time, about.
RANGE_KEYS = 1_000_000
#: Chunks that ask together at most; a task holds the keys and counts of so many.
TOGETHER = 6
END = np.uint64(0x0123456789ABCDEF)
#: Keys are 56 bits of a hash whose lowest two say the order.
KEY_BITS = 56
#: A context of count c gives c / (c + this) of a prediction, by the number of its words; the failure arc has the rest.
UNSURE = {1: 8.0, 2: 3.0}


def squeezed(numbers: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def restored(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def keyed(hashes: np.ndarray, order: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - KEY_BITS)) & ~np.uint64(3) | np.uint64(order)


CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, ids binary, tokens long, train long"


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 5, held: int = 1) -> DataFrame:
    """One row per chunk of texts: word hashes, and each token as its word's number in the chunk.

    Tokens are the lower-cased words (A-Z; ASCII white space parts them) and one end. A text is in one chunk whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        out: list[bool] = []
        arrays: list[np.ndarray] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            all_tokens = np.concatenate(arrays)
            codes, words = pd.factorize(all_tokens)
            # Frequent words get small numbers.
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            lengths = np.array([len(a) for a in arrays], np.int32)
            train = int(lengths[~np.array(out)].sum())
            columns = [number, ids, out, lengths.tolist(), squeezed(words[order]), squeezed(rank[codes]), size, train]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = ["chunk", "doc_ids", "held", "lengths", "words", "ids", "tokens", "train"]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                for doc, is_held, one in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found = one.encode("utf-8", "surrogatepass").lower().split()
                    tokens = np.empty(len(found) + 1, np.uint64)
                    tokens[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
                    tokens[-1] = END
                    ids.append(doc)
                    out.append(is_held)
                    arrays.append(tokens)
                    size += len(tokens)
                    if size >= CHUNK_TOKENS:
                        yield chunk()
                        ids, out, arrays, size = [], [], [], 0
                        number += 1
        if arrays:
            yield chunk()

    rows = texts(docs, key, text).select("doc_id", (fold("doc_id", parts) == held).alias("held"), "text")
    return rows.mapInArrow(run, CHUNK)


class Grams:
    """The n-grams of a chunk: for each order the distinct keys, and the number of each token's n-gram (-1: none)."""

    def __init__(self, held: list[bool], lengths: list[int], words: bytes, ids: bytes) -> None:
        self.lengths = np.asarray(lengths, np.int64)
        self.train = np.repeat(~np.asarray(held, bool), self.lengths)
        at = restored(ids, "<u4").astype(np.int64)
        hashes = restored(words, "<u8")
        tokens = hashes[at]
        codes, found = pd.factorize(keyed(hashes, 1))  # words whose keys are equal are one
        self.at = [codes[at].astype(np.int64)]
        self.keys = [np.asarray(found, np.uint64)]
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        previous = tokens
        for order in (2, 3):
            chain = np.zeros(len(tokens), np.uint64)
            chain[1:] = mixed(previous[:-1], tokens[1:])
            inside = place >= order - 1
            codes, found = pd.factorize(keyed(chain[inside], order))
            at = np.full(len(tokens), -1, np.int64)
            at[inside] = codes
            self.at.append(at)
            self.keys.append(np.asarray(found, np.uint64))
            previous = chain

    def counts(self, order: int) -> np.ndarray:
        """How often each n-gram of an order occurs in this chunk's training texts."""
        at = self.at[order - 1]
        return np.bincount(at[self.train & (at >= 0)], minlength=len(self.keys[order - 1]))

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys of the chunk in ascending order, and where each comes from in the orders laid end to end."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        return keys[order], order


ASKED = "range long, chunks array<long>, keys binary, counts array<binary>"


def questions(table: DataFrame, ranges: int) -> DataFrame:
    """One row per few chunks and range of keys: the chunks, their distinct keys in the range (as differences), and for each of the chunks
    one more than its training count of each key, 0 for a key that it doesn't have."""

    def cut(keys: np.ndarray) -> dict[int, slice]:
        number = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(keys)]])
        return {int(number[start]): slice(start, end) for start, end in zip(cuts[:-1], cuts[1:], strict=True)}

    def rows(several: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        parts = [cut(keys) for _, keys, _ in several]
        columns: list[list] = [[], [], [], []]
        for number in sorted(set().union(*parts)):
            here = [(chunk, keys[part[number]], counts[part[number]]) for (chunk, keys, counts), part in zip(several, parts, strict=True) if number in part]
            distinct = here[0][1] if len(here) == 1 else np.unique(np.concatenate([keys for _, keys, _ in here]))
            marks = []
            for _, keys, counts in here:
                mark = np.zeros(len(distinct), np.uint32)
                mark[np.searchsorted(distinct, keys)] = counts + np.uint32(1)
                marks.append(squeezed(mark))
            steps = squeezed(np.diff(distinct, prepend=np.uint64(0)))
            for column, value in zip(columns, (number, [chunk for chunk, _, _ in here], steps, marks), strict=True):
                column.append(value)
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["range", "chunks", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                grams = Grams(row["held"], row["lengths"], row["words"], row["ids"])
                keys, order = grams.asked()
                several.append((row["chunk"], keys, np.concatenate([grams.counts(n) for n in (1, 2, 3)])[order].astype(np.uint32)))
                del grams, keys, order
                if len(several) == TOGETHER:
                    yield from rows(several)
                    several = []
        if several:
            yield from rows(several)

    return table.mapInArrow(run, ASKED)


def answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Add up the counts of a range of keys over all chunks, and answer each chunk in the order it asked."""
    keys = [np.cumsum(restored(k, "<u8"), dtype=np.uint64) for k in asked["keys"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    places = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    totals = np.zeros(len(distinct), np.uint64)
    for place, marks in zip(places, asked["counts"], strict=True):
        for mark in marks:
            found = restored(mark, "<u4")
            totals[place] += np.maximum(found, 1) - np.uint32(1)  # a row's keys are distinct
    known = int(((distinct & np.uint64(3)) == 1)[totals > 0].sum())
    chunks, replies = [], []
    for place, names, marks in zip(places, asked["chunks"], asked["counts"], strict=True):
        own = totals[place]
        chunks += [int(name) for name in names]
        replies += [squeezed(own[restored(mark, "<u4") > 0]) for mark in marks]
    return pd.DataFrame({
        "chunk": chunks, "range": int(asked["range"].iloc[0]), "totals": replies, "words": [known, *[0] * (len(replies) - 1)],
    })


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Automaton:
    """The part of the model's automaton that a chunk's texts can visit.

    State 0 knows no word before, states 1 to W the last word, those above the last two; only contexts that occur in training are
    ever entered. The arcs of a state are the n-grams that go on from its context: each has the interpolated probability of its word
    and the state that it leads to. Where a state has no arc for a word, its failure arc leads to the state without the first
    word, with the weight that the state leaves to it. State 0 has an arc for every word.
    """

    def __init__(self, grams: Grams, totals: np.ndarray, tokens: int, words: int) -> None:
        sizes = np.cumsum([len(k) for k in grams.keys])[:-1]
        one, two, three = (c.astype(np.float64) for c in np.split(totals, sizes))
        self.size = len(one)
        self.known = one > 0
        base = (one + 0.5) / (tokens + 0.5 * (words + 1))
        word_of, context, suffix = {}, {}, {}
        for order in (2, 3):
            at = grams.at[order - 1]
            place = np.zeros(len(grams.keys[order - 1]), np.int64)
            inside = np.flatnonzero(at >= 0)
            place[at[inside]] = inside  # any place of the n-gram tells its parts
            word_of[order] = grams.at[0][place]
            context[order], suffix[order] = grams.at[order - 2][place - 1], grams.at[order - 2][place]
        share1, share2 = one / (one + UNSURE[1]), two / (two + UNSURE[2])
        # Weights and ends of the failure arcs of all states.
        self.leave = np.concatenate([[1.0], 1.0 - share1, 1.0 - share2])
        self.fail = np.concatenate([np.zeros(1 + self.size, np.int64), 1 + word_of[2]])
        # Arcs from state 0, from words and from pairs: there is one if the n-gram occurs in training.
        with np.errstate(divide="ignore", invalid="ignore"):
            from_word = share1[context[2]] * two / one[context[2]] + (1.0 - share1[context[2]]) * base[word_of[2]]
            from_pair = share2[context[3]] * three / two[context[3]] + (1.0 - share2[context[3]]) * from_word[suffix[3]]
        self.is_arc = [np.ones(len(one), bool), two > 0, three > 0]
        self.weight = [base, from_word, from_pair]
        self.to = [np.where(self.known, 1 + np.arange(self.size), 0), 1 + self.size + np.arange(len(two)), 1 + self.size + suffix[3]]
        self.base = base

    def walk(self, grams: Grams) -> np.ndarray:
        """The probability of each token: all texts step from left to right together, each in its state."""
        found = np.empty(len(grams.at[0]))
        starts = np.cumsum(grams.lengths) - grams.lengths
        longest = np.argsort(-grams.lengths, kind="stable")
        starts, lengths = starts[longest], grams.lengths[longest]
        state = np.zeros(len(starts), np.int64)
        going = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for step, active in enumerate(going):
            at, now = starts[:active] + step, state[:active]
            p, weight, open_ones = np.empty(active), np.ones(active), np.arange(active)
            for words in (2, 1, 0):  # words that the state knows: each failure arc takes one away
                here = now[open_ones]
                mine = here > self.size if words == 2 else here > 0 if words == 1 else here >= 0
                of = open_ones[mine]
                if not len(of):
                    continue
                arc = grams.at[words][at[of]]
                hit = self.is_arc[words][arc]  # a context that was entered has an n-gram here, so no arc is -1
                on, off = of[hit], of[~hit]
                p[on] = weight[on] * self.weight[words][arc[hit]]
                if len(off):
                    weight[off] *= self.leave[now[off]]
                    now[off] = self.fail[now[off]]
                state[on] = self.to[words][arc[hit]]
                open_ones = np.concatenate([open_ones[~mine], off]) if words else open_ones[:0]
            found[at] = p
        return found


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score all texts with a model of those that aren't held out.

    One row per document: doc_id, held_out (a fifth, by the id), n_tokens, n_known (tokens known from training),
    train_tokens, base_score and score: log10 probability by single words with half a count added, and
    by the model of up to three words. Contexts are interpolated: a context of count c gives the share c / (c + ``UNSURE``),
    the rest comes from the shorter context and at last from the base. Counts are those of all training texts.
    A null or empty text is its end alone. Repeated rows count and are scored as often as they occur. No
    documents give no rows; without training texts every probability is that of an unknown word.

    Nothing depends on a hot word or passage: a chunk asks for each n-gram once. The number of ranges
    follows the number of tokens, so a task adds up about ``RANGE_KEYS`` keys at any size.
    """
    spark = docs.sparkSession
    table = saved(chunks(docs, key, text), "chunks")
    tokens, train = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * tokens // RANGE_KEYS + 1)
    answered = saved(
        questions(table, ranges).repartition(ranges, "range").groupBy("range").applyInPandas(answer, "chunk long, range long, totals binary, words long"),
        "answers",
    )
    words = answered.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                row = batch.slice(start, 1).to_pylist()[0]
                grams = Grams(row["held"], row["lengths"], row["words"], row["ids"])
                _, order = grams.asked()
                totals = np.zeros(len(order), np.uint64)
                totals[order] = np.concatenate([restored(r["totals"], "<u8") for r in row["replies"]])
                automaton = Automaton(grams, totals, train, words)
                known, base = automaton.known[grams.at[0]], np.log10(automaton.base)[grams.at[0]]
                full = np.log10(automaton.walk(grams))
                ends = np.cumsum(grams.lengths) - grams.lengths
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(grams.lengths),
                    pa.array(np.add.reduceat(known.astype(np.int64), ends)), pa.array(np.full(len(ends), train, np.int64)),
                    pa.array(np.add.reduceat(base, ends)), pa.array(np.add.reduceat(full, ends)),
                ]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays(columns, names)

    # A few chunks a task, however many there are.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // (4 * CHUNK_TOKENS) + 1)
    asked = table.select("chunk", "doc_ids", "held", "lengths", "words", "ids").repartition(parts, "chunk")
    # Dealt before they are grouped, so that answers travel once.
    replies = answered.repartition(parts, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "totals"))).alias("replies"))
    return asked.join(replies, "chunk").drop("chunk").mapInArrow(run, SCORES)
