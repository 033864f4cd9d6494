"""Language model, toxicity and quality: brute force, held-out accuracy, odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from findspan.llm import importance, ngrams, toxicity
from findspan.llm.common import table

TEXTS = [
    (i, " ".join(random.Random(i % 40).choice(["the", "Of", "and", "éa", "b", f"w{j}"]) for j in range(i % 60))) for i in range(300)
] + [(900, None), (901, ""), (902, "the\tTHE\x0bthe"), (900, None), (None, "keyless text"), (903, "long text " * 30_000)]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_counts_and_base_score_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(ngrams, "RANGE_KEYS", 300)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in TEXTS], "doc_id long, text string, score double").repartition(3)
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in TEXTS}
    count = collections.Counter(w for i, t in TEXTS if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    by_id = dict(TEXTS)
    rows = ngrams.score_texts(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        words = tokens(by_id[r.doc_id])
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
    assert ngrams.score_texts(docs.limit(0)).count() == 0


def test_scores_equal_a_plain_automaton_and_are_probabilities():
    texts = [["a", "b", "a", "b", "c"], ["a", "b", "d"], ["c"]]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        t = [*t, None]
        one.update(t)
        two.update(zip(t, t[1:], strict=False))
        three.update(zip(t, t[1:], t[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def p(word, context):
        base = (one[word] + 0.5) / (n + 0.5 * (v + 1))
        if context and one[context[-1]]:
            c = one[context[-1]]
            base = c / (c + 8) * two[(context[-1], word)] / c + 8 / (c + 8) * base
        if len(context) == 2 and two[tuple(context)]:
            c = two[tuple(context)]
            base = c / (c + 3) * three[(*context, word)] / c + 3 / (c + 3) * base
        return base

    for context in ([], ["a"], ["a", "b"], ["x", "a"], ["b", "a"], ["d"]):
        assert sum(p(w, context) for w in ["a", "b", "c", "d", None, "unknown"]) == pytest.approx(1.0)
    hashes = {w: ngrams.END if w is None else np.uint64(zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 % (1 << 64)) for w in ["a", "b", "c", "d", "x", None]}
    asked = [*texts, ["x", "a", "b", "a"], ["a", "b", "x"]]
    flat = [w for t in asked for w in [*t, None]]
    words = sorted({hashes[w] for w in flat})
    ids = np.array([words.index(hashes[w]) for w in flat], np.uint32)
    grams = ngrams.Grams([False] * 5, [len(t) + 1 for t in asked], ngrams.squeezed(np.array(words)), ngrams.squeezed(ids))
    grams.train[sum(len(t) + 1 for t in texts) :] = False
    totals = np.concatenate([grams.counts(k) for k in (1, 2, 3)])
    automaton = ngrams.Automaton(grams, totals, n, v)
    full = automaton.walk(grams)
    want = [p(w, [*t, None][max(0, k - 2) : k]) for t in asked for k, w in enumerate([*t, None])]
    assert full.tolist() == pytest.approx(want)
    # Every failure arc leads to a shorter context, and only state 0 has none.
    assert (automaton.fail[1 + automaton.size :] > 0).all() and (automaton.fail[1 + automaton.size :] <= automaton.size).all()


def test_partitions_and_chunks_change_no_score(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = []
    for parts, size in ((1, 1 << 20), (32, 1 << 20), (7, 400)):
        monkeypatch.setattr(ngrams, "CHUNK_TOKENS", size)
        rows = ngrams.score_texts(docs.repartition(parts, F.xxhash64("doc_id", "text"))).collect()
        found.append(sorted(((r.doc_id or -1, r.score) for r in rows)))
    for other in found[1:]:
        assert [i for i, _ in other] == [i for i, _ in found[0]]
        assert [x for _, x in other] == pytest.approx([x for _, x in found[0]], rel=1e-12)


def test_chunks_answer_in_the_order_asked():
    rng = np.random.default_rng(0)
    for kind in ("<u4", "<u8"):
        numbers = rng.integers(0, 1 << 31, 1000).astype(kind)
        assert (ngrams.restored(ngrams.squeezed(numbers), kind) == numbers).all()
    assert len(ngrams.restored(ngrams.squeezed(np.zeros(0, np.uint32)), "<u4")) == 0


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    scored = ngrams.score_texts(table(spark, "/root/testdata/sf0.01", "documents"))
    row = scored.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert row.s > row.b + 0.1 * row.n


def test_toxicity_on_held_out_documents_and_odd_rows(spark):
    rng = random.Random(9)
    bad = ["dreck", "schmutz", "unflat"]
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice("!?., x"))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(5000, None), (5001, ""), (5002, "w1 " * 50_000), (None, "keyless dreck"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    marks = spark.createDataFrame([*labels, (0, 1, 1), (7, None, None), (None, 1, 1), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    hits = sum(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert hits >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (5000, 5001, 5002)} == {5000: 0, 5001: 0, 5002: 0}
    kept = toxicity.keep_clean(docs.withColumnRenamed("label", "toxicity"), marks)
    assert kept.columns == ["doc_id", "text", "toxicity"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    none = toxicity.classify(docs, marks.limit(0)).agg(F.min("score"), F.max("score"), F.max("predicted")).first()
    assert tuple(none) == (0.5, 0.5, 0)
    assert toxicity.classify(docs.limit(0), marks).count() == 0


def test_quality_selects_good_documents_and_copes_with_odd_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = importance.sample_by_importance(docs, labels).join(labels, "doc_id").groupBy("quality", "selected").count().collect()
    n = collections.Counter({(r.quality, r.selected): r["count"] for r in got})
    assert n[1, True] >= 0.995 * (n[1, True] + n[1, False]) and n[0, False] >= 0.97 * (n[0, True] + n[0, False])
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "some words", 3.0), (2, "", 2.0)], "doc_id long, text string, log_weight double")
    kept = importance.keep_selected(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 4  # nothing to compare with: all stay
    assert importance.keep_selected(odd, labels.limit(0)).count() == 4
    assert importance.sample_by_importance(odd.limit(0), labels).count() == 0


def test_top_k_is_exact(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice([rng.gauss(0, 50), 1.5, 1.5, -3.0])) for i in range(3000)]
    weighed = spark.createDataFrame(rows, "doc_id long, sample_key double")
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (0, 1, 700, 1500, 2999, 3000, 4000):
        got = {tuple(r) for r in importance.top_k(weighed, k, bins=7).collect()}
        assert got == set(ordered[:k])


def test_weights_are_sums_of_log_ratios():
    ratios = np.linspace(-1, 1, 1 << importance.BITS)
    found = importance.features("The cat the the")
    assert len(found) == 4 + 3 + 4 + 2
    assert importance.best_cut(np.array([1.0, 2.0, 8.0, 9.0]), np.array([False, False, True, True])) == 5.0
    assert importance.best_cut(np.array([1.0, 2.0]), np.array([True, True])) == -np.inf
    assert float(ratios[found].sum()) == pytest.approx(sum(ratios[f] for f in found))


def test_an_ngram_that_chunks_ask_together_travels_once(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 300)
    text = " ".join(f"w{k}" for k in range(299))
    docs = spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string").coalesce(1)
    asked = ngrams.questions(ngrams.chunks(docs), 3).collect()
    assert sorted({tuple(r.chunks) for r in asked}, key=len) == [(6, 7), (0, 1, 2, 3, 4, 5)]
    assert sum(len(ngrams.restored(r["keys"], "<u8")) for r in asked) == 2 * (300 + 299 + 298)
    # Every chunk gets an answer for each of its keys.
    table = ngrams.questions(ngrams.chunks(docs), 3).toPandas()
    answers = [ngrams.answer(part) for _, part in table.groupby("range")]
    got = collections.Counter()
    for part in answers:
        for chunk, totals in zip(part["chunk"], part["totals"], strict=True):
            got[chunk] += len(ngrams.restored(totals, "<u8"))
    assert got == {k: 300 + 299 + 298 for k in range(8)}
    assert sum(part["words"].sum() for part in answers) == 300
