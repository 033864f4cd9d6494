"""Shares and differences against plain Python in whole numbers."""

import collections
import random
import re

import pyarrow as pa

from findspan.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=50):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOW))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, c in df.items() if c >= least}
        sources = {d[1] for d in docs if d[0] == lang}
        n = {s: collections.Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in sources}
        total = sum(n.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(n[s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def fixture(sources=7):
    rng = random.Random(13)
    words = ["".join(rng.choice("abÄéßx日😀") for _ in range(rng.randint(1, 4))) for _ in range(90)]
    rows = []
    for i in range(400):
        lang = rng.choice(("en", "en", "en", "de", None, "one", "li\nne"))
        own = words[: rng.randint(20, 90)]
        rows.append((i, rng.choice((" ", "_1", "`")).join(rng.choice(own).title() for _ in range(rng.randint(0, 40))), lang, f"s{rng.randrange(sources)}"))
    rows += [(i, "few", "rare", f"s{i % 3}") for i in range(5)] + [(None, None, None, None), (7, "", "en", ""), (7, "", "en", ""), (8, "a b " * 9000, "one", "ü")]
    return rows + [(9, "b", "single", "alone")]


SCHEMA = "doc_id long, text string, lang string, source string"


def test_rows_equal_plain_python(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in divergence.divergence(docs, least=10, top=20).collect())
    assert got == plain(rows, 10, 20)


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "TILE_TERMS", 16)
    rows = fixture(9)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in divergence.divergence(docs, least=10, block_terms=60).collect())
    assert got == plain(rows, 10)


def test_shares_are_exact_beyond_long(spark):
    n = 9_000_000_000_000_001
    found = spark.createDataFrame([(n, 3 * n, 77)], "n long, t long, v long").select(divergence._share(*map(divergence.F.col, "ntv")).alias("p")).first().p
    assert found == 1 + 10**9 * (n + 5) // (3 * n + 5 * 77)


def test_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame(fixture()[:40], SCHEMA)
    more = docs.selectExpr("*", "1 AS tokens", "'x' AS term", "2 AS n", "3 AS rank", "4 AS counts")
    assert divergence.divergence(docs.limit(0)).count() == 0
    assert sorted(map(tuple, divergence.divergence(more, least=3).collect())) == sorted(map(tuple, divergence.divergence(docs, least=3).collect()))
    nothing = divergence.divergence(docs, least=1000).collect()
    assert nothing and all(r.part == "pair" and r.value == 0 for r in nothing)


def test_fit_and_model_get_fewer_tokens_than_occur(spark, monkeypatch):
    """A task hands on a token once, and once per group and binary digit of its occurrences."""
    kept = {}
    saved = divergence.saved
    monkeypatch.setattr(divergence, "saved", lambda df, purpose: kept.setdefault(purpose, saved(df, purpose)))
    rows = [(i, "Alpha beta " * 100 + f"gamma x{chr(97 + i % 26)}y", "en", f"s{i % 2}") for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    divergence.group_sums(docs, least=10)
    lists = [c for c, kind in kept["tokens"].dtypes if kind == "array<string>"]
    handed = sum(len(r[c] or ()) for r in kept["tokens"].collect() for c in lists)
    assert 0 < handed < 200  # of 101,000 occurrences in 2,000 pairs of document and term
    assert sorted(tuple(r) for r in divergence.divergence(docs, least=10).collect()) == plain(rows, 10)


def test_combined_documents_keep_all_counts(monkeypatch):
    monkeypatch.setattr(divergence, "LIST_TOKENS", 7)
    rng = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdefgé" for b in "xyz"]
    rows = [(rng.choice(("en", "de")), rng.choice("st"), " ".join(rng.choices(words, k=rng.randrange(300)))) for _ in range(900)] + [("none", "", "")]
    want, want_documents = collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        want.update((lang, source, f"{lang}\n{w}") for w in text.split())
        want_documents.update({f"{lang}\n{w}" for w in text.split()})
    table = pa.table(dict(zip(("lang", "source", "text"), zip(*rows, strict=True), strict=True)))
    for gathered, held in ((2_000_000, 1_000_000), (5_000, 10), (5_000, 1_000_000)):  # the task hands on at the end, often, or adds up often
        monkeypatch.setattr(divergence, "_GATHERED", gathered)
        monkeypatch.setattr(divergence, "_HELD", held)
        got, documents, groups = collections.Counter(), collections.Counter(), set()
        for r in pa.Table.from_batches(divergence._combined(iter(table.to_batches(250)))).to_pylist():
            if r["source"] is not None:
                groups.add((r["lang"], r["source"]))
            for token in r["counted"] or ():
                got[r["lang"], r["source"], token] += r["weight"]
            for token, n in zip(r["seen"] or (), r["documents"] or (), strict=True):
                documents[token] += n
        assert got == want and documents == want_documents and groups == {r[:2] for r in rows}


def test_terms_are_cut_as_the_pattern_cuts_them():
    text = "".join(map(chr, range(0x300))) + "Ä\u00a0B\u2003c\u2028D\u0085e K\u212a ıİ 日本😀x"
    table = pa.table({"lang": ["l"], "source": ["s"], "text": [text]})
    got = [t for r in pa.Table.from_batches(divergence._combined(iter(table.to_batches()))).to_pylist() for t in r["seen"] or ()]
    assert sorted(got) == sorted({f"l\n{t}" for t in re.findall(divergence.TERM, text.translate(LOW))})
