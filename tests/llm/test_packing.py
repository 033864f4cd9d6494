"""Packing: every id once, in gapless sequences, and neighbours on the curve."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from findspan.llm import packing

TEXTS = [
    (1, "Hello world, don't stop!"), (2, ""), (3, None), (4, "größe è ñandú \n\n  x\t\ty 123 4567"), (5, "word " * 30_000),
    (6, "a<|endoftext|>b"), (1, "Hello world, don't stop!"), (None, "keyless"), (7, "​\U0001f600 ok \x00 \r\n"), (8, "ab" * 1023),
]


def test_ids_offsets_and_checksums(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in TEXTS], "doc_id long, text string, n long").repartition(3)
    rows = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in TEXTS:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert r.sequence_id * 2048 + r.offset == at and r.offset + r.length <= 2048
        at += r.length
        ids = np.array(want[r.doc_id][0][r.start : r.start + r.length])
        assert np.frombuffer(r.ids, "<u2").tolist() == ids.tolist()
        assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id][0])
    for i, lists in want.items():
        assert sum(r.length for r in rows if r.doc_id == i) == sum(map(len, lists))
    assert at == sum(len(x) for lists in want.values() for x in lists)
    assert packing.pack(docs.limit(0)).count() == 0


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, levels in ((2, 4), (3, 3), (4, 2)):
        side = 1 << levels
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        places = packing.hilbert(cells, levels)
        order = cells[np.argsort(places)]
        assert sorted(places.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_are_packed_together(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.repeat(F.lit("the cat sat on a mat "), 20)).otherwise(F.repeat(F.lit("öffne größere Türen für Übung "), 20)).alias("text"),
    )
    mixed = packing.pack(docs).groupBy("sequence_id").agg(F.count_distinct(F.col("doc_id") % 2).alias("n")).filter("n > 1").count()
    assert mixed <= 1
