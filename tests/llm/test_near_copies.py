"""SimHash fingerprints, links and components against brute force; odd tables."""

import itertools
import random

import xxhash
from pyspark.sql import functions as F

from findspan.llm import components, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_simhash(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id of each id's component."""
    group = {i: i for i, _ in prints}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            low, high = sorted((top(i), top(j)))
            group[high] = low
    return {i: top(i) for i, _ in prints}


def fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrnlÉé") for _ in range(rng.randint(2, 7)))
    docs = []
    for base in range(6):
        text = [word() for _ in range(400)]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(400)] = word()
            docs.append(" ".join(copy))
    docs += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    docs += ["", "   \n", "One", "one", "two three", " x", docs[0], docs[0]]
    return list(enumerate(docs))


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, plain_simhash(t)) for i, t in rows]
    assert len(found) == len(rows)
    assert {i: r.fp % (1 << 64) for i, r in found.items()} == dict(prints)
    assert {i: r.component_id for i, r in found.items()} == plain_components(prints)


def test_close_pairs_lose_no_link_for_any_block_choice(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(15)}
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 1, k) for k, p in enumerate(sorted(prints))], "fp long, n long, least long")
    ids = {p - (1 << 64) if p >> 63 else p: k for k, p in enumerate(sorted(prints))}
    want = plain_components(list(enumerate(sorted(prints))))
    for spare in (2, 3, 4):
        edges = [(ids[r.u], ids[r.v]) for r in simhash.close_pairs(table, spare=spare).collect()]
        assert all((sorted(prints)[a] ^ sorted(prints)[b]).bit_count() <= 4 for a, b in edges)
        links = spark.createDataFrame(edges, "u long, v long")
        top = {r.u: r.v for r in components.stars(links).collect()}
        assert {k: top.get(k, k) for k in ids.values()} == want


def test_dense_group_gives_about_as_many_links_as_members(spark):
    group = [(1 << a) | (1 << b) for a, b in itertools.combinations(range(40), 2)] + [0]
    table = spark.createDataFrame([(g, 900 if g == 0 else 1, 0) for g in group], "fp long, n long, least long")
    assert simhash.close_pairs(table).count() < 12 * len(group)


def test_long_chain_of_links_is_one_component(spark):
    n = 700
    links = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    top = components.stars(links).collect()
    assert sorted((r.u, r.v) for r in top) == [(k, 0) for k in range(1, n)]
    assert components.stars(links.limit(0)).count() == 0


def test_one_of_each_keeps_columns_and_copes_with_odd_rows(spark):
    rows = [
        (1, "a b c d e", "x", "s", 9, 7), (2, "a b c d e", "y", "s", 9, 8), (2, "a b c d e", "y", "s", 9, 8),
        (None, None, None, None, None, None), (3, "", "z", "s", 0, 1), (4, "other words stand in this one", "q", "s", 9, 2),
        (None, "keyless but not alone", None, None, None, 3), (5, "w " * 50_000, "l", "s", 1, 4),
    ]
    docs = spark.createDataFrame(rows, SCHEMA + ", fp long").withColumnRenamed("source", "_key")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r.doc_id or 0, r.text[:9] if r.text else "", r.fp) for r in kept.collect()) == [
        (0, "keyless b", 3), (1, "a b c d e", 7), (3, "", 1), (4, "other wor", 2), (5, "w w w w w", 4)
    ]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
