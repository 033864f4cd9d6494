"""Near copies by five-word shingles against brute force over all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from findspan.llm import nearcopies


def plain_sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_groups(rows):
    group = {i: i for i, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    sets = {i: plain_sets(t or "") for i, t in rows}
    for i, j in itertools.combinations(sets, 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            low, high = sorted((top(i), top(j)))
            group[high] = low
    return {i: top(i) for i, _ in rows}


def fixture():
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 8)))
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randint(60, 300))]
        for step in range(10):
            copy = list(text)
            for _ in range(rng.randint(0, max(2, len(text) // 40))):  # similarities on both sides of 0.8
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).title() if step % 3 == 0 else "  ".join(copy))
            if base % 4 == 0:
                text = copy  # a chain: its ends are not similar
    rows += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows += ["", None, " \n", "one two", "One  two", "one two three", rows[0], rows[0]]
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark):
    rows = fixture()
    want = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert got == want
    kept = corpus_pipeline.without_near_copies(spark, docs, "unused")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_fingerprints_of_the_grid_give_links(spark, monkeypatch):
    rng = random.Random(29)
    text = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    rows = [(k, " ".join([*text, f"x{k}"])) for k in range(40)]  # one shingle of 797 differs
    rows += [(100 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    closed = nearcopies._close
    monkeypatch.setattr(nearcopies, "_close", lambda prints: seen.append(closed(prints)) or seen[-1])
    # Bands that no two texts share: what is linked now the fingerprints have found.
    sketched = nearcopies.sketches
    alone = F.array(*[F.xxhash64("set_id", F.lit(i)) for i in range(nearcopies.BANDS)])
    monkeypatch.setattr(nearcopies, "sketches", lambda *given: sketched(*given).withColumn("bands", alone))
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert got == {i: 0 if i < 100 else i for i, _ in rows}
    assert 39 <= seen[0].count() <= 15 * 80


def test_members_far_from_the_pivot_and_odd_rows(spark):
    rng = random.Random(24)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(150):  # one family around a text, similar to it but many not to each other
        copy = list(text)
        for at in rng.sample(range(400), 8):
            copy[at] = f"x{k}{at}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows + [(None, "a b"), (None, "a b"), (7, rows[7][1])], "doc_id long, text string")
    got = nearcopies.near_copies(docs).collect()
    want = plain_groups(rows)
    assert len(got) == len(rows) + 3
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert nearcopies.one_of_each(docs).count() == len(set(want.values())) + 1
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0


def family(n, changed):
    """Copies of one text of 120 words, each with so many words changed."""
    rng = random.Random(changed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(n):
        copy = list(text)
        for at in rng.sample(range(120), changed):
            copy[at] = f"x{k}y{at}"
        rows.append((k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("n", [400, 800])
def test_pairs_grow_with_the_members_of_a_family(spark, monkeypatch, n):
    listed, similar = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, sets: listed.append(pairs.count()) or similar(pairs, sets))
    rows = family(n, 1)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(listed) <= 10 * n
    assert got == plain_groups(rows)


def test_a_spread_family_is_joined_by_a_part_of_its_pairs(spark, monkeypatch):
    """Copies around no centre, of which only one pair in thirty is similar: links of the first pairs spare most others."""
    listed, similar = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, sets: listed.append(pairs.count()) or similar(pairs, sets))
    rows = family(800, 2)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)
    assert len(listed) > 2 and sum(listed) <= 800 * 799 / 2 / 6


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    text = [f"w{rng.randrange(9)}" for _ in range(60_000)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:30_000], "other", *text[30_000:]])), (3, "short"), (4, None)]
    docs = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows], "doc_id long, text string, set_id int, cell string, component_id int")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == plain_groups(rows)
    kept = nearcopies.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_links_that_fingerprints_and_bands_both_find_are_verified_once(spark, monkeypatch):
    """A dense family: its pivots join it, so the pairs that are close by their fingerprints need no look."""
    listed, similar = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, sets: listed.append(pairs.count()) or similar(pairs, sets))
    rng = random.Random(31)
    text = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(k, " ".join([*text[: 3 * k], f"x{k}", *text[3 * k + 1 :]])) for k in range(100)]
    rows += [(100 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for k in range(40)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)
    assert 99 <= sum(listed) <= 450
