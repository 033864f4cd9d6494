"""Benchmark passages in documents: exact, edited, shared by very many, and none."""

import random

import numpy as np

from findspan.llm import contamination


def plain_align(item, window):
    best = 0
    table = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_table():
    rng = random.Random(6)
    for _ in range(100):
        item, window = ([rng.randrange(5) for _ in range(rng.randint(1, 25))] for _ in range(2))
        assert contamination.align(np.array(item, np.uint64), np.array(window, np.uint64))[0] == plain_align(item, window)


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfaeiou") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(25, 50)))) for k in range(12)]
    docs, want = [], set()
    for i in range(120):
        text = [word() for _ in range(rng.randint(20, 300))]
        if i % 3 == 0:  # one passage is in a third of all documents
            k = 0 if i % 2 else i % 12
            passage = items[k][1].split()
            for _ in range(len(passage) // 8 if i % 4 else 0):
                passage[rng.randrange(len(passage))] = word()
            at = rng.randrange(len(text))
            text[at:at] = passage
            want.add((i, k))
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    return items, docs, want


def test_finds_what_brute_force_alignment_finds(spark, monkeypatch):
    items, rows, want = corpus()
    odd = [(500, None), (501, ""), (502, "w " * 40_000 + items[3][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows + odd], "doc_id long, text string, score double")
    bench = spark.createDataFrame([*items, (90, None), (91, "two words"), items[0]], "item_id long, text string")
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 5)  # several blocks
    got = contamination.contaminated(docs, bench).collect()
    brute = set()
    for i, t in rows:
        for k, item in items:
            a, b = contamination.words(item), contamination.words(t)
            if contamination.align(a, b)[0] >= contamination.THRESHOLD * 2 * len(a):
                brute.add((i, k))
    assert brute == want
    assert {(r.doc_id, r.item_id) for r in got} == want | {(502, 3)}
    assert sum(r.doc_id == 0 for r in got) == 2
    kept = contamination.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows + odd} - {i for i, _ in want} - {502}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert contamination.contaminated(docs, bench.limit(0)).count() == 0
    assert contamination.contaminated(docs.limit(0), bench).count() == 0
    assert contamination.keep_uncontaminated(docs, bench.limit(0)).count() == 1


def edited(rng, passage, word, how):
    """A copy of a passage: every n-th word replaced, left out or doubled by another, or a part of it alone."""
    kind, n = how
    if kind == "replaced":
        return [word() if i % n == n - 1 else w for i, w in enumerate(passage)]
    if kind == "left out":
        return [w for i, w in enumerate(passage) if i % n != n - 1]
    if kind == "put in":
        return [x for i, w in enumerate(passage) for x in ([w, word()] if i % n == n - 1 else [w])]
    length = max(1, round(len(passage) * n / 100))
    at = rng.choice([0, len(passage) - length])
    return passage[at : at + length]


def test_edited_and_partial_copies_as_in_brute_force(spark):
    rng = random.Random(17)
    common = ["of", "the", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("bcdfaeiou") for _ in range(7))
    hows = [("replaced", n) for n in (2, 3, 4, 5, 6)] + [("left out", n) for n in (2, 3, 5)]
    hows += [("put in", n) for n in (1, 2, 4)] + [("part", n) for n in (35, 40, 45, 50)]
    items, docs, clear = [], [], 0
    for length in (3, 4, 5, 6, 11, 30, 40, 60, 100):
        for how in hows:
            passage = [word() for _ in range(length)]
            text = [word() for _ in range(rng.randint(20, 60))]
            text[10:10] = edited(rng, passage, word, how)
            items.append((len(items), " ".join(passage)))
            docs.append((len(docs), " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {
        (r.doc_id, r.item_id): r.score
        for r in contamination.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    want = {}
    for k, item in items:
        a = contamination.words(item)
        for i, text in docs:
            score = contamination.align(a, contamination.words(text))[0] / (2 * len(a))
            if score >= contamination.THRESHOLD:
                want[i, k] = score
                clear += i == k
    assert got == want
    assert clear > len(items) * 0.6  # most of the copies reach the threshold


def test_every_alignment_at_the_threshold_has_the_seeds():
    rng = random.Random(18)
    for _ in range(3000):
        threshold = rng.choice([0.3, 0.4, 0.6, 0.9])
        item, text = ([rng.randrange(rng.choice([4, 12])) for _ in range(rng.randint(3, n))] for n in (25, 40))
        a, b = np.array(item, np.uint64), np.array(text, np.uint64)
        frequency = {int(s): rng.randint(1, 9) for s in contamination.seeds(a, threshold)}
        index = contamination.rare_seeds([a], frequency, threshold)
        if len(a) * threshold > 1:
            best = contamination.align(a, b)[0]
            windows = list(index.windows(b, index.maybe()))
            found = max([contamination.align(a, b[low:high])[0] for _, low, high in windows], default=0)
            assert found == best or best < threshold * 2 * len(a)
