"""Exact copies against plain grouping; weak digests, hot groups and odd rows."""

import hashlib
import re

from pyspark.sql import functions as F

from findspan.llm import exactcopies


def plain(rows):
    whole = {}
    for i, t in rows:
        whole.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = {}
    for t, ids in whole.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i] = (min(known, default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
    return out


ROWS = [(i, f"text {i % 37}" + " \t" * (i % 3)) for i in range(400)] + [(1000 + i, "hot\x0btext" if i % 2 else "hot text") for i in range(1500)]
ROWS += [(5000, ""), (5001, None), (5002, " "), (5003, "\n\n"), (5004, " "), (5005, "w " * 60_000), (5006, "w\n" * 60_000), (-3, "last"), (7000, "last")]


def found(rows, spark, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return exactcopies.exact_copies(docs, **options).collect()


def test_groups_equal_plain_grouping(spark):
    got = found(ROWS, spark)
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_digest) for r in got} == plain(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_equal_digests_of_different_texts_are_told_apart(spark):
    want = plain(ROWS)
    for digest in (lambda c: F.lit("same"), lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)):
        got = found(ROWS, spark, digest=digest)
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: w[:2] for i, w in want.items()}
        assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({w[0] for w in want.values()})


def test_repeated_rows_missing_keys_and_clashing_columns(spark):
    rows = [(1, "a b", "x", 1), (1, "a  b", "x", 2), (1, "a b", "x", 1), (None, "a b", "y", 3), (None, "lone", "z", 4), (None, "lone", "z", 5), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, Kept long").withColumn("row", F.lit(0)).withColumn("salt", F.lit("s"))
    got = exactcopies.exact_copies(docs).collect()
    assert sorted(((r.doc_id or 0), (r.keep_id or 0), r.group_size) for r in got) == [(0, 0, 2), (0, 0, 2), (0, 1, 4), (1, 1, 4), (1, 1, 4), (1, 1, 4), (2, 2, 1)]
    assert sorted((r.doc_id or 0) for r in got if r.kept) == [0, 1, 2]
    stay = exactcopies.without_copies(docs)
    assert stay.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r.doc_id or 0, r.text or "") for r in stay.collect())[0] == (0, "lone") and stay.count() == 3
    assert exactcopies.exact_copies(docs.limit(0)).count() == 0 and exactcopies.without_copies(docs.limit(0)).count() == 0


def test_no_python_and_no_hot_key(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exactcopies.exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    per_salt = exactcopies.groups(docs).groupBy("digest", "keep_key").agg(F.count("*").alias("salts"), F.max("group_size").alias("n"))
    hot = max(per_salt.collect(), key=lambda r: r.n)
    assert hot.n == 1500 and 250 < hot.salts <= exactcopies.SALTS
