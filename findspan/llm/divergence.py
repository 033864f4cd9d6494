"""How far the sources of a language differ in their words.

A token is the language and the term in one, so that one vocabulary serves every language by itself. A task first puts its documents
together: it hands on each token once with its number of documents, and per (language, source) and binary digit of the numbers of
occurrences the tokens that have the digit. Numbers of documents are added up and tokens of too few documents go, before
``CountVectorizer`` learns the vocabulary of the others; ``vocabSize`` is the largest integer, so that no term is left out. Its model
turns the lists of tokens into exact sparse vectors, far fewer and shorter than one per document. The vectors, times what their
digits are worth, are summed per (language, source) within the tasks, as a summarizer does but in whole numbers, and then across them.

The model keeps its vocabulary on the driver and in every task. Above ``BLOCK_TERMS`` the kept terms are fitted in as many blocks by
hash, each in a pass of its own.

Pairs of sources are evaluated in tiles: some sources against some sources over the terms of one hash block that any of them
has; a tile gives one sum per pair. Terms that no source of a tile has differ by the shares of unseen terms, which
are one number per source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findspan.llm.common import saved

TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
MIN_DOCUMENTS = 30
ALL_TERMS = 2**31 - 1
#: Shares are parts of a billion, and every term counts so many times more than it occurs.
UNIT, EXTRA = 1_000_000_000, 5
TOP = 50
#: Terms of a vocabulary that the driver and the tasks hold at a time.
BLOCK_TERMS = 1_000_000
#: Sources on a side of a tile, and terms.
TILE_SOURCES, TILE_TERMS = 64, 2048
#: Tokens of a list at most.
LIST_TOKENS = 2048
#: Entries that a task gathers before it adds them up, and sums it holds before it hands them on.
_GATHERED, _HELD = 2_000_000, 1_000_000
#: A-Z lower-cased and a space for what no term has, in UTF-8; ``bytes.split`` then cuts at these spaces alone.
_FOLDED = bytes(c if c > 127 else ord(chr(c).lower()) if re.fullmatch(TERM, chr(c)) else 32 for c in range(256))
#: The term's part of a key.
_LOW = 2**32 - 1
_COMBINED = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("weight", pa.int64()), ("counted", pa.list_(pa.string())),
    ("seen", pa.list_(pa.string())), ("documents", pa.list_(pa.int64())),
])


class _Places(dict):
    """Numbers of keys, in the order in which they come."""

    def __missing__(self, key: object) -> int:
        self[key] = place = len(self)
        return place


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, every one once, and the sums of their counts, in whole numbers."""
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(count[order], first) if len(key) else count


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a task put together, in fewer lists of tokens (language, line feed, term).

    Lists of ``seen`` have every token once, and ``documents`` how many documents have it. Lists of ``counted`` have the tokens whose number
    of occurrences in (lang, source) has the binary digit ``weight``. Every (lang, source) also has a row without lists.
    """
    terms, langs, groups = _Places(), _Places(), _Places()
    own, seen, gathered = [], [], 0  # keys and counts: occurrences of (group, term), documents of (language, term)

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(field.name, pa.nulls(size, field.type)) for field in _COMBINED], schema=_COMBINED)

    def listed(head: np.ndarray, *flat: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """Lists of the entries of equal head, long ones in pieces, and where each begins."""
        first = np.union1d(np.flatnonzero(np.diff(head, prepend=-1)), np.arange(0, len(head), LIST_TOKENS))
        offsets = pa.array(np.append(first, len(head)).astype(np.int32))
        return first, [pa.ListArray.from_arrays(offsets, x) for x in flat]

    def out() -> Iterator[pa.RecordBatch]:
        names, words = pa.array(langs, pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string())
        group_lang, group_source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        yield rows(len(groups), lang=group_lang, source=group_source)

        key, count = _added(own)
        group = key >> 32
        tokens = pc.binary_join_element_wise(group_lang.take(pa.array(group)), words.take(pa.array(key & _LOW)), "\n")
        for digit in range(int(count.max(initial=0)).bit_length()):
            mine = np.flatnonzero(count >> digit & 1)
            first, (lists,) = listed(group[mine], tokens.take(pa.array(mine)))
            of = pa.array(group[mine[first]])
            yield rows(len(first), lang=group_lang.take(of), source=group_source.take(of), weight=pa.array(np.full(len(first), 1 << digit)), counted=lists)

        key, count = _added(seen)
        lang = key >> 32
        tokens = pc.binary_join_element_wise(names.take(pa.array(lang)), words.take(pa.array(key & _LOW)), "\n")
        first, (lists, documents) = listed(lang, tokens, pa.array(count))
        yield rows(len(first), seen=lists, documents=documents)

    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            found = [text.translate(_FOLDED).split() for text in part.column(2).cast(pa.binary()).to_pylist()]
            word = np.fromiter(map(terms.__getitem__, chain.from_iterable(found)), np.int64)
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            key, count = np.unique(of << 32 | word, return_counts=True)
            of, word = key >> 32, key & _LOW
            lang, source = part.column(0).to_pylist(), part.column(1).to_pylist()
            own.append((np.array([groups[x] for x in zip(lang, source, strict=True)])[of] << 32 | word, count))
            seen.append((np.array([langs[x] for x in lang])[of] << 32 | word, np.ones(len(key), np.int64)))
            gathered += len(key)
            if gathered > _GATHERED:
                own, seen, gathered = [_added(own)], [_added(seen)], 0
                if max(len(own[0][0]), len(terms)) > _HELD:
                    yield from out()
                    own, seen = [], []
                    terms.clear(), langs.clear(), groups.clear()
    if own:
        yield from out()


def _sums(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of ``size`` terms, so many times each as its weight says, added up per source, in whole numbers; a term belongs to
    one language. A source and a term may come more than once."""
    codes = _Places()
    parts, gathered = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        keys, counts = _added(parts)
        sources = pa.array(codes, pa.string())
        for start in range(0, len(keys), 100_000):
            key, total = keys[start : start + 100_000], counts[start : start + 100_000]
            columns = [sources.take(pa.array(key // size)), pa.array((key % size).astype(np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["source", "place", "n"])

    for batch in batches:
        vectors = batch.column(2)
        indices, values = vectors.field("indices"), vectors.field("values")
        group = np.array([codes[s] for s in batch.column(0).to_pylist()], dtype=np.int64)
        lengths = np.diff(indices.offsets.to_numpy())
        times = np.repeat(batch.column(1).to_numpy(), lengths)
        parts.append((np.repeat(group, lengths) * size + indices.flatten().to_numpy(), values.flatten().to_numpy().astype(np.int64) * times))
        gathered += len(times)
        if gathered > _GATHERED:
            parts, gathered = [_added(parts)], 0
            if len(parts[0][0]) > _HELD:
                yield from out()
                parts = []
                codes.clear()
    if parts:
        yield from out()


def _named(names: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums with the language and the term of each place in the vocabulary."""
    split = [token.rsplit("\n", 1) for token in names.value]
    langs, terms = (pa.array([t[i] for t in split], pa.string()) for i in (0, 1))
    for batch in batches:
        place = batch.column(1)
        yield pa.RecordBatch.from_arrays([langs.take(place), batch.column(0), terms.take(place), batch.column(2)], ["lang", "source", "term", "n"])


def group_sums(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = MIN_DOCUMENTS, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """All groups (lang, source), and the sums (lang, source, term, n) of their documents' vectors over the kept terms."""
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(empty(lang, "lang"), empty(source, "source"), empty(text, "text"))
    kinds = "lang string, source string, weight long, counted array<string>, seen array<string>, documents array<long>"
    tokens = saved(rows.mapInArrow(_combined, kinds), "tokens")
    groups = tokens.filter("source IS NOT NULL").select("lang", "source").distinct()
    # A task has a token or a sum about once, so they are dealt out before they are added up.
    seen = tokens.filter("seen IS NOT NULL").select(F.inline(F.arrays_zip("seen", "documents"))).repartition("seen")
    kept = saved(seen.groupBy("seen").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least).select("seen"), "kept")
    blocks = max(1, -(-kept.count() // block_terms))
    sums = []
    for block in range(blocks):
        def mine(token: Column, block: int = block) -> Column:
            return F.pmod(F.shiftright(F.xxhash64(token), 8), F.lit(blocks)) == block

        model = CountVectorizer(inputCol="seen", outputCol="counts", minDF=1.0, vocabSize=ALL_TERMS)
        try:
            model = model.fit(kept.filter(mine(F.col("seen"))).select(F.array("seen").alias("seen")))
        except IllegalArgumentException:  # it refuses an empty vocabulary
            continue
        names = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
        counted = tokens.filter("counted IS NOT NULL").select("source", "weight", "counted")
        if blocks > 1:
            counted = counted.withColumn("counted", F.filter("counted", lambda token: mine(token)))  # noqa: B023 - used at once
        vectors = model.setInputCol("counted").transform(counted)
        part = vectors.select("source", "weight", "counts").mapInArrow(partial(_sums, len(names.value)), "source string, place int, n long")
        part = part.repartition("source", "place").groupBy("source", "place").agg(F.sum("n").alias("n"))
        sums.append(saved(part.mapInArrow(partial(_named, names), "lang string, source string, term string, n long"), "sums"))
    nothing = groups.limit(0).select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"))
    return groups, reduce(DataFrame.unionByName, sums) if sums else nothing


def _share(n: Column, total: Column, size: Column) -> Column:
    """One and the whole part of a billion times (n + 5) / (total + 5 size), in exact arithmetic; null without terms."""
    whole = F.call_function("div", (n + EXTRA).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + EXTRA * size).cast("decimal(20,0)"))
    return F.when(size > 0, whole + 1)


def _tile(table: pa.Table) -> pa.Table:
    """All pairs of sources of a tile: the sum of differences over the terms that any of them has, how many these are, the
    difference of unseen terms. Rows without a term are the sources themselves."""
    own = table.filter(pc.is_null(table["term"]))
    entries = table.filter(pc.is_valid(table["term"]))
    names = own["source"].to_pylist()
    tiles, unseen = own["tile"].to_numpy(), own["p"].to_numpy()
    place = {s: i for i, s in enumerate(names)}
    terms = entries["term"].combine_chunks().dictionary_encode()
    shares = np.repeat(unseen[:, None], len(terms.dictionary), axis=1)
    if len(entries):
        row = np.array([place[s] for s in entries["source"].to_pylist()])
        shares[row, terms.indices.to_numpy()] = entries["p"].to_numpy()
    first, second = int(table["a"][0].as_py()), int(table["b"][0].as_py())
    left, right, sums, gaps = [], [], [], []
    for i in np.flatnonzero(tiles == first):
        others = np.arange(i + 1, len(names)) if first == second else np.flatnonzero(tiles == second)
        left += [names[i]] * len(others)
        right += [names[j] for j in others]
        sums.append(np.abs(shares[others] - shares[i]).sum(axis=1))
        gaps.append(np.abs(unseen[others] - unseen[i]))
    number = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), pa.int64())
    return pa.table({
        "lang": pa.array([table["lang"][0].as_py()] * len(left), pa.string()), "source": pa.array(left, pa.string()), "item": pa.array(right, pa.string()),
        "f": number(sums), "seen": pa.array(np.full(len(left), shares.shape[1], dtype=np.int64)), "gap": number(gaps),
    })


def _pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for every two sources of a language, both ways round."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("size").alias("terms")).select(
        "lang", F.ceil(F.col("sources") / TILE_SOURCES).alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE_TERMS)).alias("blocks")
    )
    def dealt(rows: DataFrame, block: Column) -> DataFrame:
        tiled = rows.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
        met = tiled.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return met.select(
            "lang", F.least("tile", "met").alias("a"), F.greatest("tile", "met").alias("b"), block.alias("block"), "tile", "source", "term", "p"
        )

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = dealt(groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("unseen", F.lit(0)).alias("p")), every)
    all_rows = own.unionByName(dealt(entries.select("lang", "source", "term", "p"), F.pmod(F.xxhash64("term"), F.col("blocks"))))
    tiles = all_rows.groupBy("lang", "a", "b", "block").applyInArrow(_tile, "lang string, source string, item string, f long, seen long, gap long")
    sums = tiles.groupBy("lang", "source", "item").agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"), F.max("gap").alias("gap"))
    known = sums.join(groups.groupBy("lang").agg(F.max("size").alias("size")), "lang")
    one = saved(known.select("lang", "source", "item", (F.col("f") + (F.col("size") - F.col("seen")) * F.col("gap")).alias("value")), "pairs")
    return one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = MIN_DOCUMENTS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) on each source of each language.

    A language keeps the terms that at least ``least`` of its documents have. A group's share of a kept term is
    ``1 + floor(10^9 (n + 5) / (N + 5 V))``: n its occurrences there, N those of all kept terms, V the number of kept terms.

    * ``pair``: to every other source of the language (item) the sum of differences of shares over all kept terms, 0 where there
      are none.
    * ``term``: the ``top`` terms (item) that the group has and uses more than the whole language, with the excess.

    Ranks start at 1 per group and part, by falling value, ties by item in the order of UTF-8. A missing language, source or text counts as
    empty, and the empty language and source are ones like any other. A group without terms has pairs, but no terms. Repeated rows are
    documents of their own; very long texts are read whole; an empty table gives no rows; other columns are not used.
    """
    groups, sums = group_sums(docs, lang, source, text, least, block_terms)
    totals = saved(sums.groupBy("lang", "term").agg(F.sum("n").alias("n")), "totals")
    whole = totals.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count("*").alias("size"))
    own = sums.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    known = groups.join(own, ["lang", "source"], "left").join(whole.select("lang", "size"), "lang", "left").fillna(0, ["own_n", "size"])
    known = saved(known.withColumn("unseen", _share(F.lit(0).cast("long"), F.col("own_n"), F.col("size"))), "groups")
    entries = sums.join(known.drop("unseen"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("own_n"), F.col("size")))
    entries = saved(entries.select("lang", "source", "term", "p"), "shares")
    shares = totals.join(whole, "lang").select("lang", "term", _share(F.col("n"), F.col("all_n"), F.col("size")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = _pairs(known, entries).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = entries.join(shares, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def divergence_sql() -> str:
    """The same for the documents, for DuckDB."""
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}),
        langs AS (SELECT lang, sum(n) AS all_n, count(*) AS size FROM kept GROUP BY lang),
        counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL),
        own AS (SELECT lang, source, sum(n) AS own_n FROM counts GROUP BY ALL),
        groups AS (SELECT g.lang, g.source, coalesce(own_n, 0) AS own_n, coalesce(size, 0) AS size
            FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own ON own.lang = g.lang AND own.source = g.source LEFT JOIN langs ON langs.lang = g.lang),
        shares AS (SELECT g.lang, g.source, kept.term, coalesce(counts.n, 0) AS n,
            (1 + {UNIT}::HUGEINT * (coalesce(counts.n, 0) + {EXTRA}) // (g.own_n + {EXTRA} * g.size)::HUGEINT)::BIGINT AS p,
            (1 + {UNIT}::HUGEINT * (kept.n + {EXTRA}) // (langs.all_n + {EXTRA} * langs.size)::HUGEINT)::BIGINT AS q
            FROM groups g JOIN kept ON kept.lang = g.lang JOIN langs ON langs.lang = g.lang
            LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = kept.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(max(s.value), 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM shares x
                JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
            ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
        parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
    """
