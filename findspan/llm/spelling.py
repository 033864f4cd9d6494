"""Spelling variants: words one edit apart, found by walking a distributed trie with frontiers of states.

The trie is a table of edges (node, first letter, label, child). A node is a prefix where words part or end, known by a
hash; a label is the run of letters up to the next node, so that the number of levels follows the branchings and not the
letters of the longest word. A state (word, position, node, edits) says that the first ``position`` letters of a word lead to a
node after 0 or 1 edits. Each round joins the states with the edges:

* along the word: (node, next letter) is the key, and the whole label must be the word's next letters;
* by an edit, from states without one: another letter in place of the word's (only a larger one), or a letter more. The
  reverse edits are found from the other word.

A state with one edit that has used up its word at a node where a word ends is a pair of neighbours. An edit is made where the
two words part, so it has no other alignment; and only in the second half of a word, where the trie is sparse: words that part
earlier agree in their second halves, and are found in a second trie of reversed words, in the same rounds. So the first
state of a word has its first half read, and the tries have no edges above. Letters that a child has
(a mask of 63 remainders, and one bit for the end of a word) are looked at before a state is written. Pairs are
compared once more at the end, so that equal hashes of prefixes can neither add nor lose one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import saved

#: Letters of a run, A-Z lower-cased.
RUN = "[a-z\u00C0-\u00FF]"
MIN_LETTERS, MIN_COUNT = 6, 5
#: One in so many runs loses a letter.
DAMAGED = 199
#: How much more frequent than a word its form must be.
FACTOR = 5
#: Factor and starts of the prefix hashes of both tries.
_STEP, _ROOTS = 0x9E3779B97F4A7C15, (0x243F6A8885A308D3, 0x13198A2E03707344)
_END = 63
#: Distinct words that a task holds before it hands them on.
_HELD = 200_000
_WRAP = (1 << 64) - 1


def _counts(damaged: int, letters: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts and how often they occur, added up within the task; a word may come more than once."""
    found: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return batch

    run = re.compile(f"{RUN}{{{letters},}}")
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            begun = zlib.crc32(f"{key}:".encode())
            # On bytes only A-Z change; a run that is too short can't become a word.
            for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(word.encode(), begun)
                if h % damaged == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < letters:
                        continue
                found[word] += n
            if len(found) >= _HELD:
                yield out()
    yield out()


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", damaged: int = DAMAGED, letters: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """The words of a corpus and their numbers of occurrences (word, n).

    Runs of letters, A-Z lower-cased. The CRC-32 of ``<key>:<run>`` decides which runs lose a letter, and which one. A missing
    text has no runs; a missing key counts as empty text.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.mapInArrow(partial(_counts, damaged, letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words both ways round, with the hashes of their prefixes of ``start`` letters and more."""
    for batch in batches:
        for first in range(0, batch.num_rows, 2000):
            given = batch.column(0).slice(first, 2000).to_pylist()
            for back, root in enumerate(_ROOTS):
                turned = [w[::-1] for w in given] if back else given
                starts = [(len(w) - 1) // 2 for w in turned]
                hashes = []
                for word, start in zip(turned, starts, strict=True):
                    h, found = root, [root]
                    for letter in word:
                        h = ((h ^ ord(letter)) * _STEP) & _WRAP
                        h ^= h >> 29
                        found.append(h)
                    hashes.append(np.array(found[start:], dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bool(back)] * len(turned)), pa.array(turned, pa.string()), pa.array(starts, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["back", "word", "start", "hashes"],
                )


def _letter(word: str, position: str) -> Column:
    return F.expr(f"substring({word}, {position} + 1, 1)")


def _has(mask: str, letter: Column) -> Column:
    """Whether a child may go on with a letter; the empty letter stands for the end of a word."""
    return F.call_function("getbit", F.col(mask), F.when(letter == "", _END).otherwise(F.ascii(letter) % _END)) == 1


def _trie(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Starts (back, word, position, node), edges (parent, letter, label, child, mask) and ends (child, near) of both tries."""
    paths = saved(vocabulary.select("word").mapInArrow(_prefixes, "back boolean, word string, start int, hashes array<long>"), "prefixes")
    steps = paths.select("back", "word", "start", F.posexplode("hashes").alias("depth", "node"))
    steps = steps.withColumn("depth", F.col("start") + F.col("depth")).withColumn("next", _letter("word", "depth"))
    bit = F.when(F.col("next") == "", _END).otherwise(F.ascii("next") % _END)
    nodes = (
        steps.groupBy("node").agg(
            F.min("next").alias("low"), F.max("next").alias("high"), F.max(F.col("depth") == F.col("start")).alias("begins"),
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("mask"),
        )
        .filter("low <> high OR low = '' OR begins").select("node", "mask")
    )
    stops = steps.select("back", "word", "depth", "node").join(nodes, "node")
    # The nodes of a word's own path, in order: no more than it has letters.
    path = stops.groupBy("back", "word").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "mask"))).alias("path"))
    links = path.select("word", "path", F.explode(F.expr("sequence(1, size(path) - 1)")).alias("i")).select(
        "word", F.expr("path[i - 1]").alias("a"), F.expr("path[i]").alias("b")
    )
    label = F.expr("substring(word, a.depth + 1, b.depth - a.depth)")
    edges = links.select(F.col("a.node").alias("parent"), label.alias("label"), F.col("b.node").alias("child"), F.col("b.mask").alias("mask"))
    edges = saved(edges.distinct().withColumn("letter", _letter("label", "0")), "edges")
    starts = paths.select("back", "word", F.col("start").alias("position"), F.col("hashes")[0].alias("node"))
    ends = paths.select(F.element_at("hashes", -1).alias("child"), F.col("word").alias("near"))
    return starts, edges, ends


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """All pairs (word, near) of words (distinct, not empty) that differ by exactly one letter put in, left out or replaced, both ways round."""
    starts, edges, ends = _trie(vocabulary)
    states = starts.withColumn("edits", F.lit(0))
    size, length = F.char_length("label"), F.char_length("word")
    at = F.col("position")
    found = None
    while True:
        ahead = states.withColumn("own", _letter("word", "position"))
        same = ahead.join(edges, (F.col("node") == F.col("parent")) & (F.col("own") == F.col("letter")))
        same = same.filter(F.col("label") == F.substring("word", at + 1, size)).select("back", "word", (at + size).alias("position"), "child", "mask", "edits")
        # A word of n letters that parts from the other after k agrees with it in n - 1 - k (replaced) or n - k (put in) at the end.
        parting = ahead.filter((F.col("edits") == 0) & (at >= F.floor(length / 2)))
        other = parting.join(edges, (F.col("node") == F.col("parent")) & (F.col("own") != F.col("letter")))
        tail = F.substring("label", F.lit(2), size)
        replaced = (F.col("own") != "") & (F.col("own") < F.col("letter")) & (tail == F.substring("word", at + 2, size - 1))
        put_in = (at >= F.floor((length + 1) / 2)) & (tail == F.substring("word", at + 1, size - 1))
        moves = F.array_compact(F.array(F.when(replaced, at + size), F.when(put_in, at + size - 1)))
        other = other.filter(replaced | put_in).select("back", "word", F.explode(moves).alias("position"), "child", "mask", F.lit(1).alias("edits"))
        after = same.unionByName(other).filter((F.col("edits") == 0) | _has("mask", _letter("word", "position")))
        states = saved(after.select("back", "word", "position", F.col("child").alias("node"), "edits"), "frontier")
        done = states.filter((F.col("edits") == 1) & (at == length)).select("back", "word", F.col("node").alias("child"))
        found = done if found is None else found.unionByName(done)
        states = states.filter((F.col("edits") == 0) | (at < length))
        if states.isEmpty():
            break
    pairs = found.join(ends, "child").filter(F.levenshtein("word", "near", 1) == 1)
    turned = pairs.select(*[F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")]).distinct()
    return turned.unionByName(turned.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _roots(formed: DataFrame) -> DataFrame:
    """From rows (word, form) to (word, root); forms become more frequent with each step, so they end. Each round doubles the steps."""
    current = saved(formed.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("later"))
        moved = current.join(further, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved"))
        current = saved(moved, "forms")
        if current.filter("moved").isEmpty():
            return current.select("word", "root")
        current = current.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per word of ``words``.

    ``form`` is the most frequent near word (ties: the smallest in code-point order), if that is at least ``factor`` times as
    frequent as the word, else null; ``root`` is the end of the chain of forms, the word itself where it has none. ``n_near`` is the
    number of near words (0 if none), ``form_n`` the form's n or null.

    Nulls and empty texts have no words; repeated rows count as often as they are given; a very long run is one word; an empty
    table, or one without frequent words, gives no rows. Other columns are not used, whatever their names.
    """
    vocabulary = saved(words(docs, key, text), "words")
    pairs = neighbours(vocabulary)
    rated = pairs.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = rated.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    )
    joined = vocabulary.join(best, "word", "left").withColumn("best_n", -F.col("best.minus"))
    chosen = F.col("best_n") >= factor * F.col("n")
    formed = saved(
        joined.select(
            "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
