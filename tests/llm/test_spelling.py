"""Spelling variants against plain counting and comparison of all words."""

import collections
import random
import re
import zlib

from findspan.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, damaged=199):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(n):
    out, form = {}, {}
    for w in n:
        close = [y for y in n if near(w, y)]
        best = min(close, key=lambda y: (-n[y], y), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
        out[w] = [form.get(w), None, n[w], len(close), n[form[w]] if w in form else None]
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def fixture():
    rng = random.Random(11)
    letters = "abcdeé×ÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(40)] + ["a" * k for k in range(5, 12)]
    rows = []
    for doc in range(150):
        text = []
        for _ in range(120):
            w = list(rng.choice(stems[: 3 + int(rng.expovariate(0.15))]))
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [rng.choice(letters)], [w[at], rng.choice(letters)]))
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((doc, rng.choice((" ", "-", "1", ", ")).join(text)))
    return rows + [(None, "tremend tremend tremend"), (900, None), (901, ""), (902, "x" * 30_000)] + [(902, "x" * 30_000 + " " + "x" * 29_999)] * 5


def test_words_neighbours_and_forms_equal_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    n = plain_words(rows)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == n and len(n) > 300
    want = plain_variants(n)
    got = spelling.spelling_variants(docs).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(x[0] and x[1] != x[0] for x in want.values())  # a chain of forms
    assert want["x" * 29_999][3] == 1


def test_every_run_may_lose_a_letter(spark):
    rows = [(i, "lettered Lettered LETTERÉD") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.words(docs, damaged=2).collect()} == plain_words(rows, 2)


def test_chains_ties_and_odd_tables(spark):
    text = " ".join(["rooted"] * 150 + ["rootex"] * 30 + ["rootexx"] * 6 + ["roxted"] * 30 + ["zooted"] * 150)
    odd = spark.createDataFrame([(None, text, 1, "w", 2)], "doc_id long, text string, word long, near string, n long")
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(odd).collect()}
    assert got == plain_variants(plain_words([(None, text)]))
    assert got["rootexx"][:2] == ("rootex", "rooted") and got["roxted"][0] == "rooted"
    for rows in ([], [(1, None)], [(1, "few words here")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
