"""Stupid-backoff scores of documents under a byte trigram model of all of them.

Everything between counting and the scores is joins and sums.  Each text is
exploded into its distinct n-grams with their counts: trigrams, and the one
unigram and one bigram that its first two bytes are.  The count tables come from
all documents; unigrams and bigrams have at most 256 and 65,536 entries by their
nature and are broadcast, trigrams are partitioned by hash.  A trigram's score is
a column of its count table,

    log c(abc) / c(ab)              if abc occurs at least ``min_count`` times,
    log BACKOFF * c(bc) / c(b)      else if bc does,
    log BACKOFF**2 * c(c) / total   otherwise,

so that one join by trigram and one sum by document remain.  A trigram that
every document holds is one row per document; the join splits such partitions.

Defined results: a NULL or empty text has no bytes and a NULL score; rows of one
id are scored as one document; rows without an id are one document without an
id; an empty table gives no rows; other columns are ignored.

``report`` is the byte model of the registered SQL.  Its tables end at the 2^24
byte trigrams; ``word_report`` scores words instead, whose tables grow with the
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, NO_ID, Prefix, Slice, record_batch, slices, stage, word_hashes, word_spans

BACKOFF = 0.4
MIN_COUNT = 2

#: A gram's code is its bytes below a leading 1, so codes of lengths differ.
_ONE, _TWO, _THREE = 1 << 8, 1 << 16, 1 << 24

COUNTS = "gram int, n long"
_COUNTS = pa.schema([("gram", pa.int32()), ("n", pa.int64())])
EXPLODED = "id_key long, gram int, n int"
_EXPLODED = pa.schema([("id_key", pa.int64()), ("gram", pa.int32()), ("n", pa.int32())])


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of every trigram, and the text it is in."""
    wide = data.astype(np.int32)
    codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(wide) > 2 else wide[:0]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(codes)]
    inside = np.arange(len(codes)) + 2 < offsets[text + 1]
    return codes[inside] | _THREE, text[inside]


def beginnings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and the first two bytes of every text, as grams, and their text."""
    lengths = np.diff(offsets)
    one, two = np.flatnonzero(lengths >= 1), np.flatnonzero(lengths >= 2)
    first = data[offsets[one]].astype(np.int32) | _ONE
    at = offsets[two]
    second = (data[at].astype(np.int32) << 8) | data[at + 1] | _TWO
    return np.concatenate([first, second]), np.concatenate([one, two])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per gram and task: all grams of one, two and three bytes."""
    load = np.zeros(2 * _THREE, np.int64)
    for part in slices(batches):
        wide = part.data.astype(np.int32)
        load[_ONE:_TWO] += np.bincount(wide, minlength=_TWO - _ONE)[: _TWO - _ONE]
        ends = np.zeros(len(wide), bool)
        ends[part.offsets[1:][part.lengths > 0] - 1] = True
        pairs = (wide[:-1] << 8) | wide[1:]
        load[_TWO : 2 * _TWO] += np.bincount(pairs[~ends[:-1]], minlength=_TWO)
        codes, _ = trigrams(part.data, part.offsets)
        np.add.at(load, codes, 1)
    used = np.flatnonzero(load)
    yield record_batch(_COUNTS, used.astype(np.int32), load[used])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        codes, text = trigrams(part.data, part.offsets)
        first, first_text = beginnings(part.data, part.offsets)
        keys = (np.concatenate([text, first_text]) << 25) | np.concatenate([codes, first])
        keys, n = np.unique(keys, return_counts=True)
        ids = part.numbers("id_key")
        yield record_batch(_EXPLODED, ids[keys >> 25], (keys & (2 * _THREE - 1)).astype(np.int32), n.astype(np.int32))


def count_table(texts: DataFrame) -> DataFrame:
    """How often every gram of up to three bytes occurs."""
    return texts.select("text").mapInArrow(_count, COUNTS).groupBy("gram").agg(F.sum("n").alias("n"))


def score_table(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``gram, score``: the log score of a gram's last byte after the others."""
    size = F.when(F.col("gram") >= _THREE, 3).when(F.col("gram") >= _TWO, 2).otherwise(1)
    sized = counts.withColumn("size", size)
    low_bits = F.col("gram").bitwiseAND(0xFFFF)
    one = F.broadcast(sized.where("size = 1").select(F.col("gram").alias("last"), F.col("n").alias("n_last")))
    middle = F.broadcast(sized.where("size = 1").select(F.col("gram").alias("middle"), F.col("n").alias("n_middle")))
    two = sized.where("size = 2")
    tail = F.broadcast(two.select(F.col("gram").alias("tail"), F.col("n").alias("n_tail")))
    head = F.broadcast(two.select(F.col("gram").alias("head"), F.col("n").alias("n_head")))
    total = F.broadcast(sized.where("size = 1").agg(F.sum("n").alias("total")))
    last = F.col("gram").bitwiseAND(0xFF).bitwiseOR(_ONE)
    joined = (
        sized.withColumn("last", last)
        .withColumn("middle", F.shiftright("gram", 8).bitwiseAND(0xFF).bitwiseOR(_ONE))
        .withColumn("tail", low_bits.bitwiseOR(_TWO))
        .withColumn("head", F.shiftright("gram", 8).bitwiseAND(0xFFFF).bitwiseOR(_TWO))
        .join(one, "last")
        .join(middle, "middle", "left")
        .join(tail, "tail", "left")
        .join(head, "head", "left")
        .join(total)
    )
    unigram = F.log(F.col("n_last") / F.col("total"))
    bigram = F.when(F.col("n_tail") >= min_count, F.log(F.col("n_tail") / F.col("n_middle"))).otherwise(
        F.log(F.lit(BACKOFF)) + unigram
    )
    trigram = F.when(F.col("n") >= min_count, F.log(F.col("n") / F.col("n_head"))).otherwise(
        F.log(F.lit(BACKOFF)) + bigram
    )
    score = F.when(F.col("size") == 1, unigram).when(F.col("size") == 2, bigram).otherwise(trigram)
    return joined.select("gram", score.alias("score"))


def report(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id, n_bytes, log_score, mean_log_score`` of every document.

    Sums of logarithms are rounded, so that the order of summation can't show.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_key"), "text")
    scores = score_table(stage(count_table(texts), "gram-counts"), min_count)
    grams = texts.mapInArrow(_explode, EXPLODED)
    summed = (
        grams.join(scores.hint("shuffle_hash"), "gram")
        .groupBy("id_key")
        .agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.col("score")).alias("log_score"))
    )
    none = F.lit(0).cast("long")
    return (
        texts.select("id_key")
        .distinct()
        .join(summed, "id_key", "left")
        .select(
            F.nullif("id_key", F.lit(NO_ID)).alias("doc_id"),
            F.coalesce("n_bytes", none).alias("n_bytes"),
            F.round("log_score", 3).alias("log_score"),
            F.round(F.col("log_score") / F.col("n_bytes"), 6).alias("mean_log_score"),
        )
    )


# -- the same scores over words ------------------------------------------------

#: ``gram`` is a 64-bit hash; ``head`` and ``tail`` are those of all words but the last and but the first.
WORD_COUNTS = "size int, gram long, head long, tail long, n long"
_WORD_COUNTS = pa.schema(
    [("size", pa.int32()), ("gram", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("n", pa.int64())]
)
WORD_GRAMS = "id_key long, gram long, n int"
_WORD_GRAMS = pa.schema([("id_key", pa.int64()), ("gram", pa.int64()), ("n", pa.int32())])
#: Bytes of text whose n-grams a task combines at once.
COMBINED = 8 << 20


class WordGrams:
    """Hashes of the n-grams of one to three words of a slice, and the texts they are in."""

    def __init__(self, part: Slice):
        starts, ends, self.bounds = word_spans(part.data, part.offsets, NOT_SPACE)
        prefix = Prefix(word_hashes(part.data, starts, ends))
        self.hashes = [prefix.windows(size) for size in (1, 2, 3)]
        self.text = np.repeat(np.arange(len(part)), np.diff(self.bounds))

    def places(self, size: int) -> np.ndarray:
        """The words where ``size`` words of one text begin."""
        n = len(self.hashes[size - 1])
        return np.flatnonzero(self.text[:n] == self.text[size - 1 : size - 1 + n])

    def beginnings(self, size: int) -> np.ndarray:
        """The first words of the texts of at least ``size`` words."""
        return self.bounds[:-1][np.diff(self.bounds) >= size]


def _count_words(sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, budget=COMBINED):
            grams = WordGrams(part)
            for size in sizes:
                at = grams.places(size)
                found, first, n = np.unique(grams.hashes[size - 1][at], return_index=True, return_counts=True)
                at = at[first]
                shorter = grams.hashes[size - 2] if size > 1 else np.zeros(len(grams.text) + 1, np.uint64)
                head, tail = (shorter[at + step].view(np.int64) for step in (0, 1))
                yield record_batch(_WORD_COUNTS, np.full(len(at), size, np.int32), found.view(np.int64), head, tail, n)

    return run


def _explode_words(size: int):
    """The distinct trigrams of every text with their counts, or its first gram of a smaller size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams = WordGrams(part)
            at = grams.places(size) if size == 3 else grams.beginnings(size)
            own, text = grams.hashes[size - 1][at], grams.text[at]
            order = np.lexsort((own, text))
            own, text = own[order], text[order]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
            opens = np.flatnonzero(fresh)
            n = np.diff(np.append(opens, len(own))).astype(np.int32)
            yield record_batch(_WORD_GRAMS, part.numbers("id_key")[text[opens]], own[opens].view(np.int64), n)

    return run


def word_count_table(texts: DataFrame, *sizes: int) -> DataFrame:
    """How often every gram of the given numbers of words occurs."""
    rows = texts.select("text").mapInArrow(_count_words(sizes), WORD_COUNTS)
    return rows.groupBy("size", "gram", "head", "tail").agg(F.sum("n").alias("n"))


def word_score_tables(texts: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``gram, score`` of the unigrams, bigrams and trigrams of words.

    A gram is looked up once in the table of the next shorter ones: its head if it
    occurs often enough, else its tail, whose score it backs off to.
    """
    short = stage(word_count_table(texts, 1, 2), "word-counts")
    ones = short.where("size = 1").select("gram", "n")
    total = F.broadcast(ones.agg(F.sum("n").alias("total")))
    ones = ones.crossJoin(total).select("gram", "n", F.log(F.col("n") / F.col("total")).alias("score"))
    often = F.col("n") >= min_count

    def longer(counts: DataFrame, shorter: DataFrame) -> DataFrame:
        looked = counts.select("gram", "n", F.when(often, F.col("head")).otherwise(F.col("tail")).alias("look"))
        seen = shorter.toDF("look", "n_look", "score_look")
        score = F.when(often, F.log(F.col("n") / F.col("n_look"))).otherwise(F.log(F.lit(BACKOFF)) + F.col("score_look"))
        return looked.join(seen, "look").select("gram", "n", score.alias("score"))

    twos = stage(longer(short.where("size = 2"), ones), "word-bigrams")
    threes = longer(word_count_table(texts, 3), twos)
    return tuple(table.select("gram", "score") for table in (ones, twos, threes))


def word_report(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of every document.

    Words are runs without ASCII white space, compared byte by byte.  No table is
    bounded by the alphabet, so all of them are partitioned by the hash of the gram;
    joins are left to sort and merge, which can spill and be split.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_key"), "text")
    sums = [
        texts.mapInArrow(_explode_words(size), WORD_GRAMS)
        .join(scores, "gram")
        .select("id_key", "n", (F.col("n") * F.col("score")).alias("part"))
        for size, scores in enumerate(word_score_tables(texts, min_count), 1)
    ]
    summed = (
        sums[0].unionAll(sums[1]).unionAll(sums[2])
        .groupBy("id_key")
        .agg(F.sum("n").alias("n_words"), F.sum("part").alias("log_score"))
    )
    none = F.lit(0).cast("long")
    return (
        texts.select("id_key")
        .distinct()
        .join(summed, "id_key", "left")
        .select(
            F.nullif("id_key", F.lit(NO_ID)).alias("doc_id"),
            F.coalesce("n_words", none).alias("n_words"),
            F.round("log_score", 3).alias("log_score"),
            F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"),
        )
    )
