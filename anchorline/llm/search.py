"""Ranked lexical search by dense blocked matrix multiplication.

Every item of a benchmark is a query of terms and every document is scored for it.
The items' terms are one vocabulary; a document is a vector of impacts over it, and a
tile of items times a tile of documents is a product of two dense float64 matrices.

1. One pass over the texts counts each document's terms and its occurrences of
   vocabulary terms; the counts, not the texts, are stored.
2. Totals and document frequencies are sums of the tasks' partial sums.
3. Each task multiplies item tiles (``ITEMS`` items, their own compact vocabulary in
   tiles of ``TERMS`` terms) by document tiles (``DOCS`` documents).  Weights and
   impacts are whole numbers, and a term tile ends before the sum of an item's weights
   times the largest impact reaches 2^53, so every partial sum of a product is exact;
   tiles are added in 64-bit integers.
4. A task keeps each item's best documents.  A document tile contributes all scores
   down to the last kept one, ties included, and ties are settled by id.  The tasks'
   lists are merged in two steps, first within ``SALTS`` parts of an item.

The benchmark is read in blocks of about ``BLOCK_BYTES``; only one block's items are
on the driver, and each block's results are stored before the next is read.

Defined results: a NULL or empty text has no terms and no rank; an item without terms,
or whose terms no document holds, has no rows; a document without an id comes after
all others of its score; rows of one id are documents of their own; benchmark rows
equal in id and text are one item, and one id with two texts two items; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    ALNUM,
    LOWER,
    ship,
    record_batch,
    slices,
    stage,
    word_hashes,
    word_spans,
)

LIMIT = 20
ITEMS, TERMS, DOCS = 128, 2048, 512
#: Text of the items that one pass over the documents answers.
BLOCK_BYTES = 1 << 20
SALTS = 64
#: Below this every whole number is a float64.
EXACT = 1 << 53
#: An impact is smaller than this.
IMPACT = 1_000_000

COUNTS = "doc_id long, n long, terms binary, tfs binary"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
_FREQUENCIES = pa.schema([("term", pa.int32()), ("df", pa.int64())])
_SCORES = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term, and the term offsets of the texts."""
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    starts, ends, bounds = word_spans(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), bounds


class Items:
    """A block of items: their vocabulary and each one's occurrences of its terms."""

    def __init__(self, texts: list[str | None]):
        hashes, bounds = term_hashes([(t or "").encode() for t in texts])
        self.count = len(texts)
        self.vocabulary, term = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        pairs, self.repeats = np.unique(np.stack([owner, term]), axis=1, return_counts=True)
        self.owner, self.term = pairs


def _counted(vocabulary: np.ndarray):
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data = LOWER[part.data]
            starts, ends, bounds = word_spans(data, part.offsets, ALNUM)
            hashes = word_hashes(data, starts, ends)
            n = np.diff(bounds)
            at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
            known = vocabulary[at] == hashes
            owner = np.repeat(np.arange(len(n)), n)[known]
            keys, tf = np.unique(owner * size + at[known], return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(n) + 1) * size)
            terms, tfs = (keys % size).astype(np.int32), tf.astype(np.int64)
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield record_batch(
                _COUNTS,
                part.column("doc_id"),
                n,
                [terms[a:b].tobytes() for a, b in spans],
                [tfs[a:b].tobytes() for a, b in spans],
            ).filter(pa.array(n > 0))

    return run


def _joined(batch: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind)


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_joined(batch, "terms", np.int32), minlength=size)
        found = np.flatnonzero(df)
        yield record_batch(_FREQUENCIES, found.astype(np.int32), df[found])

    return run


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of a document's score, before its weight."""
    if len(n) and int(n.max()) * 25 * documents >= 1 << 62:  # beyond 64 bits in between
        length = np.array([25 * x * documents // total for x in n.tolist()], np.int64)
    else:
        length = n * (25 * documents) // total
    return tf * 1_000_000_000 // (1000 * tf + 12 * (75 + length))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([floor(1000 * log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class TermTile:
    """Some columns of an item tile: the terms, and the weights as a sparse matrix."""

    def __init__(self, terms: np.ndarray, row: np.ndarray, column: np.ndarray, weight: np.ndarray):
        self.terms, self.row, self.column, self.weight = terms, row, column, weight

    def dense(self, items: int) -> np.ndarray:
        out = np.zeros((items, len(self.terms)))
        out[self.row, self.column] = self.weight
        return out


def term_tiles(items: int, terms: np.ndarray, row: np.ndarray, column: np.ndarray, weight: np.ndarray) -> Iterator[TermTile]:
    """The columns in tiles whose products with impacts stay exact.

    A weight that is too large alone is given in several tiles.
    """
    most = EXACT // IMPACT - 1
    while len(weight):
        now = np.minimum(weight, most)
        order = np.argsort(column, kind="stable")
        heaviest = np.zeros(len(terms), np.int64)
        np.maximum.at(heaviest, column, now)
        lo = 0
        while lo < len(terms):
            sums = np.cumsum(heaviest[lo : lo + TERMS])
            hi = lo + max(1, int(np.searchsorted(sums, most, "right")))
            inside = order[np.searchsorted(column[order], lo) : np.searchsorted(column[order], hi)]
            yield TermTile(terms[lo:hi], row[inside], column[inside] - lo, now[inside])
            lo = hi
        left = weight > most
        row, column, weight = row[left], column[left], weight[left] - most


def item_tiles(items: Items, weight: np.ndarray) -> list[tuple[int, int, list[TermTile]]]:
    """First item, number of items and term tiles of every item tile."""
    tiles = []
    for first in range(0, items.count, ITEMS):
        count = min(ITEMS, items.count - first)
        own = (items.owner >= first) & (items.owner < first + count) & (weight[items.term] > 0)
        terms, column = np.unique(items.term[own], return_inverse=True)
        weighed = weight[items.term[own]] * items.repeats[own]
        tiles.append((first, count, list(term_tiles(count, terms, items.owner[own] - first, column, weighed))))
    return tiles


class Best:
    """The best documents of every item so far."""

    def __init__(self, items: int, limit: int):
        self.limit = limit
        self.floor = np.ones(items, np.int64)  # lower scores can't come in
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.missing = np.zeros(0, bool)

    def add(self, first: int, scores: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        """A tile of scores, items by documents, the items from ``first`` on."""
        row, at = np.nonzero(scores >= self.floor[first : first + len(scores), None])
        if not len(row):
            return
        item = np.concatenate([self.item, row + first])
        score = np.concatenate([self.score, scores[row, at]])
        docs = np.concatenate([self.doc, doc[at]])
        none = np.concatenate([self.missing, missing[at]])
        order = np.lexsort((docs, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.limit
        order = order[kept]
        self.item, self.score, self.doc, self.missing = item[kept], score[order], docs[order], none[order]
        last = rank[kept] == self.limit - 1
        self.floor[self.item[last]] = self.score[last]


def _scored(items: Items, df: np.ndarray, documents: int, total: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = item_tiles(items, weights(df, documents))
        best = Best(items.count, limit)
        place = np.full(len(df), -1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                ids = batch.column("doc_id")
                missing = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
                doc = ids.fill_null(0).to_numpy()
                term, tf = _joined(batch, "terms", np.int32), _joined(batch, "tfs", np.int64)
                held = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()])
                owner = np.repeat(np.arange(len(doc)), held)
                impact = impacts(tf, batch.column("n").to_numpy()[owner], documents, total)
                for first, count, parts in tiles:
                    scores = np.zeros((count, len(doc)), np.int64)
                    for part in parts:
                        place[part.terms] = np.arange(len(part.terms))
                        column = place[term]
                        used = np.flatnonzero(column >= 0)
                        tile = np.zeros((len(part.terms), len(doc)))
                        tile[column[used], owner[used]] = impact[used]
                        scores += (part.dense(count) @ tile).astype(np.int64)
                        place[part.terms] = -1
                    best.add(first, scores, doc, missing)
        ids = pa.array(best.doc, pa.int64(), mask=best.missing)
        yield record_batch(_SCORES, best.item.astype(np.int32), ids, best.score)

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The distinct items with a text in blocks of about ``block_bytes``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words"))
    items = items.where("words is not null").distinct()
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for number in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == number)
        yield [tuple(row) for row in chosen.collect()]


def _ranked(scores: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _best_of_block(docs: DataFrame, block: list[tuple[str | None, str]], limit: int) -> DataFrame | None:
    spark = docs.sparkSession
    items = Items([text for _, text in block])
    size = len(items.vocabulary)
    if not size:
        return None
    counted = stage(docs.mapInArrow(_counted(items.vocabulary), COUNTS), "term-counts")
    documents, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    partial = counted.select("terms").mapInArrow(_frequencies(size), "term int, df long")
    df = np.zeros(size, np.int64)
    for term, n in partial.groupBy("term").agg(F.sum("df")).collect():  # at most one block's terms
        df[term] = n
    scores = counted.mapInArrow(_scored(items, df, documents, total, limit), "item int, doc_id long, score long")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    best = _ranked(scores.withColumn("salt", salt), ["item", "salt"], limit).select("item", "doc_id", "score")
    ranked = _ranked(best, ["item"], limit)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id string")
    return stage(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def report(docs: DataFrame, benchmark: DataFrame, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``limit`` best documents."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_best_of_block(texts, block, limit) for block in item_blocks(benchmark, block_bytes)]
    found = [best for best in found if best is not None]
    if not found:
        found = [spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")]
    kind = benchmark.schema["item_id"].dataType
    return reduce(DataFrame.unionAll, found).withColumn("item_id", F.col("item_id").cast(kind))
