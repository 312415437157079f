"""Windows of tokens, dealt to buckets by their minimiser.

All windows of ``window`` tokens of a corpus are compared without writing them
out: the *minimiser* of a window is the k-mer in it with the smallest hash, and
consecutive windows with the same minimiser make one *super-k-mer*.  Equal
windows have equal minimisers, so all copies of a window meet in one bucket.

Two things keep buckets small however skewed the texts are:

* k-mers that are frequent in the corpus are chosen only in windows that hold no
  other.  Their load is measured exactly by hash slot over all k-mers; slots
  with more than ``1/SHARE`` of all k-mers are frequent (fewer than ``SHARE``).
  A passage that a third of all documents share therefore gathers only the
  windows that lie wholly inside it, not those that reach into their texts.
* Equal super-k-mers are one row with a count: only one copy of each string
  travels.
* A bucket of more than ``LIMIT`` distinct strings is divided, whatever its share
  of the corpus: its minimiser, and the k-mers that a sample of its strings have in
  common, are from then on treated like frequent ones, in every text at once, and
  its documents are dealt again.  Any such choice is exact, as equal windows still
  have equal minimisers.  What stays undivided is a bucket whose windows hold nothing
  but k-mers that were already marked.

Only super-k-mers whose minimiser occurs twice are looked at again; their texts
are fetched by document, so strings of all others never leave their task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    NOT_SPACE,
    Prefix,
    Slice,
    keyed_text,
    parallelism,
    record_batch,
    slices,
    stage,
    whole_groups,
    word_hashes,
    word_spans,
)
from .fingerprints import sliding_min

SLOT_BITS = 16
SHARE = 8192
#: distinct strings of a bucket that one task takes, and of which so many are sampled
LIMIT = 1 << 15
SAMPLE = 64
#: bytes of texts or strings that one vectorised step works on
STEP_BYTES = 1 << 18

_POSITION_BITS = np.uint64(30)
_FREQUENT = np.uint64(1 << 63)
NO_KMERS = np.zeros(0, np.uint64)

KEYS = ["id_key", "text_key"]
LOAD = "slot int, n long"
_LOAD = pa.schema([("slot", pa.int32()), ("n", pa.int64())])
RUNS = "id_key long, text_key long, start int, n_windows int, minimiser long, content long"
_RUNS = pa.schema(
    [
        ("id_key", pa.int64()),
        ("text_key", pa.int64()),
        ("start", pa.int32()),
        ("n_windows", pa.int32()),
        ("minimiser", pa.int64()),
        ("content", pa.int64()),
    ]
)
SHARED = "bucket long, kmer long"
_SHARED = pa.schema([("bucket", pa.int64()), ("kmer", pa.int64())])
STRINGS = "minimiser long, content long, copies long, first_id long, packed binary"
_STRINGS = pa.schema(
    [
        ("minimiser", pa.int64()),
        ("content", pa.int64()),
        ("copies", pa.int64()),
        ("first_id", pa.int64()),
        ("packed", pa.binary()),
    ]
)


@dataclass(frozen=True)
class Scheme:
    """What a token is, and how long windows and their minimisers are."""

    window: int
    k: int
    words: bool

    def tokens(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a slice and the token offsets of its texts."""
        if not self.words:
            return part.data, part.offsets
        starts, ends, bounds = word_spans(part.data, part.offsets, NOT_SPACE)
        return word_hashes(part.data, starts, ends), bounds

    def pack(self, text: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        """The strings of token ranges of one text."""
        if not self.words:
            return [text[a:b] for a, b in runs]
        words = text.split()
        return [b" ".join(words[a:b]) for a, b in runs]

    def starts(self, bounds: np.ndarray, width: int, total: int) -> np.ndarray:
        """A mask of the positions where ``width`` tokens of one text begin."""
        mask = np.zeros(max(0, total - width + 1), np.int32)
        long = np.diff(bounds) >= width
        first, last = bounds[:-1][long], bounds[1:][long] - width
        if not len(first):
            return mask.astype(bool)
        edges = np.zeros(len(mask) + 1, np.int32)
        np.add.at(edges, first, 1)
        np.add.at(edges, last + 1, -1)
        return np.cumsum(edges[:-1]) > 0


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def frequent_slots(texts: DataFrame, scheme: Scheme, share: int = SHARE) -> np.ndarray:
    """Marks of the hash slots that hold more than ``1/share`` of all k-mers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(1 << SLOT_BITS, np.int64)
        for part in slices(batches, budget=STEP_BYTES):
            tokens, bounds = scheme.tokens(part)
            hashes = Prefix(tokens).windows(scheme.k)
            inside = scheme.starts(bounds, scheme.k, len(tokens))
            load += np.bincount(_slots(hashes[inside]), minlength=len(load))
        used = np.flatnonzero(load)
        yield record_batch(_LOAD, used, load[used])

    load = texts.mapInArrow(count, LOAD).groupBy("slot").agg(F.sum("n").alias("n"))
    rows = load.collect()  # at most 2**SLOT_BITS
    marks = np.zeros(1 << SLOT_BITS, bool)
    total = sum(row.n for row in rows)
    marks[[row.slot for row in rows if row.n * share > total]] = True
    return marks


def super_kmers(part: Slice, scheme: Scheme, frequent: np.ndarray, shared: np.ndarray = NO_KMERS):
    """Text number, first token, windows, minimiser and content hash of each run.

    ``shared`` are the sorted hashes of k-mers that are marked one by one.
    """
    tokens, bounds = scheme.tokens(part)
    prefix = Prefix(tokens)
    hashes = prefix.windows(scheme.k)
    order = (hashes >> np.uint64(1)) & ~((np.uint64(1) << _POSITION_BITS) - np.uint64(1))
    order[frequent[_slots(hashes)]] |= _FREQUENT
    if len(shared):
        near = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
        order[shared[near] == hashes] |= _FREQUENT
    order |= np.arange(len(order), dtype=np.uint64)  # the leftmost of equals
    least = sliding_min(order, scheme.window - scheme.k + 1)
    at = (least & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    inside = scheme.starts(bounds, scheme.window, len(tokens))
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    text_of = np.searchsorted(bounds, np.arange(len(inside)), "right") - 1
    opens = inside.copy()
    opens[1:] &= ~(inside[:-1] & (at[1:] == at[:-1]) & (text_of[1:] == text_of[:-1]))
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    content = prefix.spans(first, last + scheme.window)
    owner = text_of[first]
    minimiser = hashes[at[first]]
    return owner, first - bounds[owner], last - first + 1, minimiser.view(np.int64), content.view(np.int64)


def all_runs(texts: DataFrame, scheme: Scheme, frequent: np.ndarray, shared: np.ndarray = NO_KMERS) -> DataFrame:
    """Every super-k-mer of the keyed texts as a small row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, budget=STEP_BYTES):
            owner, *columns = super_kmers(part, scheme, frequent, shared)
            keys = [part.numbers(name)[owner] for name in KEYS]
            yield record_batch(_RUNS, *keys, *columns)

    return texts.select(*KEYS, "text").mapInArrow(run, RUNS)


@dataclass(frozen=True)
class Repeats:
    """What may repeat: its super-k-mers, their texts, and one string of each."""

    scheme: Scheme
    runs: DataFrame
    texts: DataFrame
    strings: DataFrame


def in_common(texts: DataFrame, scheme: Scheme, buckets: DataFrame) -> DataFrame:
    """``minimiser``: the k-mers in at least an eighth of a sample of each bucket's strings, and its own.

    ``buckets`` has the sampled strings' ``minimiser, id_key, text_key, start, n_windows``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for text, picks in zip(part.texts(), part.column("picks").to_pylist(), strict=True):
                spans = [(p["start"], p["start"] + p["n_windows"] + scheme.window - 1) for p in picks]
                strings = pa.record_batch({"text": pa.array(scheme.pack(text, spans), pa.binary())})
                own = iter(picks)
                for packed in slices([strings]):
                    tokens, bounds = scheme.tokens(packed)
                    hashes = Prefix(tokens).windows(scheme.k).view(np.int64)
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        found = np.unique(hashes[a : b - scheme.k + 1])
                        yield record_batch(_SHARED, np.full(len(found), next(own)["minimiser"]), found)

    picks = buckets.groupBy(*KEYS).agg(F.collect_list(F.struct("minimiser", "start", "n_windows")).alias("picks"))
    asked = texts.join(picks, KEYS).dropDuplicates(KEYS)  # only the few texts asked for are sorted
    rows = asked.select("text", "picks").mapInArrow(run, SHARED)
    common = rows.groupBy("bucket", "kmer").count().where(F.col("count") >= SAMPLE // 8)
    return common.select(F.col("kmer").alias("minimiser")).unionAll(buckets.select("minimiser")).distinct()


def dealt_runs(texts: DataFrame, scheme: Scheme, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """All super-k-mers, and the minimisers that occur more than once.

    Buckets of more than ``limit`` distinct strings are dealt again until only those
    are left that can't be divided.  The marked k-mers come to the driver: some for
    every ``limit`` strings of the corpus.
    """
    frequent, shared = frequent_slots(texts.select("text"), scheme), NO_KMERS
    every = stage(all_runs(texts, scheme, frequent), "runs")
    while True:
        # stored, so that the join has plain shuffles on both sides and hot partitions can be split
        often = stage(every.groupBy("minimiser").count().where("count > 1"), "repeated-minimisers")
        large = [row.minimiser for row in often.where(F.col("count") > limit).select("minimiser").collect()]
        large = np.array(large, np.int64).view(np.uint64)
        large = np.setdiff1d(large[~frequent[_slots(large)]], shared)
        if not len(large):
            return every, often.select("minimiser")
        spark = texts.sparkSession
        asked = spark.createDataFrame([(int(m),) for m in large.view(np.int64)], "minimiser long")
        place = F.struct("id_key", "text_key", "start", "n_windows")
        strings = every.join(F.broadcast(asked), "minimiser").groupBy("minimiser", "content").agg(F.min(place).alias("at"))
        sampled = strings.groupBy("minimiser", F.pmod(F.xxhash64("content"), F.lit(SAMPLE)).alias("slot")).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("at", "content").alias("at")
        )
        sampled = stage(sampled, "sampled-strings")
        divided = sampled.groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("minimiser")
        buckets = sampled.join(divided, "minimiser").select("minimiser", "at.*")
        fresh = [row.minimiser for row in in_common(texts, scheme, buckets).collect()]
        if not fresh:
            return every, often.select("minimiser")
        shared = np.union1d(shared, np.array(fresh, np.int64).view(np.uint64))
        moved = spark.createDataFrame([(m,) for m in fresh], "minimiser long")
        concerned = stage(every.join(F.broadcast(moved), "minimiser").select(*KEYS).distinct(), "dealt-again")
        again = all_runs(texts.join(concerned, KEYS, "left_semi"), scheme, frequent, shared)
        every = stage(every.join(concerned, KEYS, "left_anti").unionAll(again), "runs")


def repeats(docs: DataFrame, scheme: Scheme, limit: int = LIMIT) -> Repeats:
    """Find the super-k-mers with a minimiser that occurs more than once."""
    texts = keyed_text(docs)
    every, often = dealt_runs(texts, scheme, limit)
    runs = stage(every.join(often, "minimiser"), "repeated-runs")

    # one copy of each string, from the document that comes first
    copies = runs.groupBy("minimiser", "content").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("id_key").alias("first_id"),
        F.min_by("text_key", "id_key").alias("text_key"),
    )
    picked = (
        runs.withColumnRenamed("id_key", "first_id")
        .join(copies, ["minimiser", "content", "first_id", "text_key"])
        .groupBy(F.col("first_id").alias("id_key"), "text_key")
        .agg(F.collect_list(F.struct("minimiser", "content", "copies", "start", "n_windows")).alias("picks"))
    )
    concerned = runs.select(*KEYS).distinct().join(picked, KEYS, "left")
    fetched = stage(texts.join(concerned, KEYS), "repeated-texts")
    return Repeats(scheme, runs, fetched.drop("picks"), _strings(fetched, scheme))


def _strings(fetched: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows: dict[tuple[int, int], tuple] = {}
            for text, first, picks in zip(part.texts(), part.numbers("id_key").tolist(), part.column("picks").to_pylist(), strict=True):
                spans = [(p["start"], p["start"] + p["n_windows"] + scheme.window - 1) for p in picks]
                for pick, packed in zip(picks, scheme.pack(text, spans), strict=True):
                    rows[pick["minimiser"], pick["content"]] = (pick["copies"], first, packed)
            columns = zip(*((*key, *row) for key, row in rows.items()), strict=True) if rows else [[] for _ in _STRINGS]
            yield record_batch(_STRINGS, *map(list, columns))

    chosen = fetched.where(F.col("picks").isNotNull()).select("id_key", "text", "picks")
    return chosen.mapInArrow(run, STRINGS)


def in_buckets(
    strings: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``work`` on tables of whole buckets, sorted by minimiser and content.

    A table holds about ``STEP_BYTES`` of strings, or one bucket with more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in whole_groups(batches, "minimiser"):
            for table in in_steps(groups):
                yield from work(table)

    dealt = strings.repartition(parallelism(strings.sparkSession), "minimiser")
    return dealt.sortWithinPartitions("minimiser", "content").mapInArrow(run, schema)


def step_edges(sizes: np.ndarray, cuts: np.ndarray, budget: int = STEP_BYTES) -> list[int]:
    """Those of the sorted ``cuts`` that divide rows of these sizes into steps of about ``budget``."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    edges = [0]
    while edges[-1] < len(sizes):
        reach = np.searchsorted(total, total[edges[-1]] + budget, "right") - 1
        at = int(np.searchsorted(cuts, reach, "right")) - 1
        if at < 0 or cuts[at] <= edges[-1]:  # more than a step between two cuts
            at = int(np.searchsorted(cuts, edges[-1], "right"))
        edges.append(int(cuts[at]) if at < len(cuts) else len(sizes))
    return edges


def in_steps(table: pa.Table, budget: int = STEP_BYTES) -> Iterator[pa.Table]:
    """The table in parts of about ``budget`` bytes of strings, cut between buckets only."""
    keys = table.column("minimiser").to_numpy()
    cuts = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
    edges = step_edges(pc.binary_length(table.column("packed")).to_numpy(), cuts, budget)
    for a, b in zip(edges, edges[1:], strict=False):
        yield table.slice(a, b - a)


def distinct_rows(table: pa.Table) -> pa.Table:
    """One row of each string: a repeated document may have sent it twice."""
    keys = np.stack([table.column(name).to_numpy() for name in ("minimiser", "content")])
    fresh = np.ones(keys.shape[1], bool)
    fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
    return table.filter(pa.array(fresh)).combine_chunks()
