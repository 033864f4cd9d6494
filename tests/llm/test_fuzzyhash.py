"""Piecewise hashes, their edit distance, and the edited text of every document."""

import hashlib
import random

from findspan.llm import fuzzyhash


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert fuzzyhash.edit_distance(a, b) == plain_distance(a, b)


def test_signature_equals_a_byte_by_byte_one():
    rng = random.Random(2)
    for length in (0, 1, 5, 8, 100, 5_000):
        data = bytes(rng.randrange(256) for _ in range(length))
        hashes = fuzzyhash.rolling(data)
        for i in range(length):
            h = sum((data[i - k] + 1) * pow(0x01000193, k, 1 << 32) for k in range(min(7, i + 1))) % (1 << 32)
            h ^= h >> 15
            h = h * 0x2C1B3C6D % (1 << 32)
            assert hashes[i] == h ^ (h >> 12)


def test_likeness():
    rng = random.Random(3)
    text = " ".join(str(rng.random()) for _ in range(300))
    other = " ".join(str(rng.random()) for _ in range(300))
    a = fuzzyhash.fingerprint(text)
    assert fuzzyhash.likeness(a, a) == 1.0 and fuzzyhash.likeness(fuzzyhash.fingerprint(""), fuzzyhash.fingerprint("")) == 1.0
    assert fuzzyhash.likeness(a, fuzzyhash.fingerprint(text[:2000] + "new words here" + text[2000:])) > 0.8
    assert fuzzyhash.likeness(a, fuzzyhash.fingerprint(other)) < 0.3
    assert fuzzyhash.likeness(a, fuzzyhash.fingerprint("short")) == 0.0


def test_edited_texts_of_all_documents(spark):
    rng = random.Random(4)
    rows = [(3 * i, "".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "x" * 90_000), (-5, "first")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, packed string").repartition(5)
    got = {r.doc_id: r for r in fuzzyhash.fingerprint_edits(docs).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(t) // 4
        changed = t[: len(t) - cut] + following[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fuzzyhash.fingerprint(t) and r.edited_fingerprint == fuzzyhash.fingerprint(changed)
        assert r.near_edited == fuzzyhash.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fuzzyhash.likeness(r.fingerprint, fuzzyhash.fingerprint(following))


def test_repeated_missing_single_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "keyless")], "doc_id long, text string")
    rows = fuzzyhash.fingerprint_edits(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 7), (1, 9), (1, 9)]
    one = fuzzyhash.fingerprint_edits(docs.limit(1)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"same tesa").hexdigest() or len(one) == 1
    assert fuzzyhash.fingerprint_edits(docs.limit(0)).count() == 0
