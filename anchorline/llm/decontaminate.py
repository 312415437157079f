"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark is cut into windows of ``window`` consecutive words (an item of
fewer words is one window).  Windows of one length share three tables: a
*shift table* over blocks of three words, which says how far the scan may jump
because no window can end in between; *suffix buckets*, keyed by the hash of a
window's last block, which name the windows to test; and the windows' own words,
compared directly, so that a hash never decides a hit.

The benchmark is a stated query set: it is searched in blocks of about
``block_bytes`` of item text, each block's tables going to every task, and the
documents are never shuffled when one block is enough.

Defined results: a NULL or wordless document has no words and no hits; an item
that is NULL, wordless or without an id has no windows; repeated items count
once per id; repeated documents each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ALNUM,
    LOWER,
    Prefix,
    Slice,
    keyed_text,
    passing,
    record_batch,
    slices,
    word_hashes,
    word_spans,
)

WINDOW = 10
BLOCK_BYTES = 4_000_000
#: words in a block of the shift table
BLOCK_WORDS = 3
#: end positions that one scanning lane covers
LANE = 256

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE_BITS = 20

SCAN = "doc_id long, id_key long, text_key long, n_words long, runs array<struct<lo:long,hi:long>>, items array<string>"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("id_key", pa.int64()),
        ("text_key", pa.int64()),
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return _WORD.findall((text or "").encode().translate(LOWER.tobytes()))


class WindowsOfLength:
    """Shift table, suffix buckets and words of all windows of one length."""

    def __init__(self, length: int, windows: list[bytes]):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.windows = windows
        self.buckets: dict[int, list[int]] = defaultdict(list)
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.uint16)
        for number, window in enumerate(windows):
            data = np.frombuffer(window, np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
            blocks = Prefix(word_hashes(data, starts, ends)).windows(self.block)
            jumps = np.arange(len(blocks) - 1, -1, -1, dtype=np.uint16)
            np.minimum.at(self.shift, self.slot(blocks), jumps)
            self.buckets[int(blocks[-1])].append(number)

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def stops(self, prefix: Prefix, bounds: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Word numbers at which a window may end, with the windows to test there.

        All lanes of the slice jump in step; a lane ends at its text's end.
        """
        blocks = prefix.windows(self.block)  # by first word of the block
        slot = self.slot(blocks)
        firsts = bounds[:-1] + self.length - 1
        lane_at, lane_end = _lanes(firsts, bounds[1:])
        found = []
        while len(lane_at):
            jump = self.shift[slot[lane_at - (self.block - 1)]]
            found.append(lane_at[jump == 0])
            lane_at = lane_at + np.maximum(jump, 1)
            going = lane_at < lane_end
            lane_at, lane_end = lane_at[going], lane_end[going]
        for end in np.concatenate(found).tolist() if found else ():
            if bucket := self.buckets.get(int(blocks[end - self.block + 1])):
                yield end, bucket


def _lanes(firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [first, end) cut into pieces of at most ``LANE``."""
    pieces = np.maximum(0, -(-(ends - firsts) // LANE))
    owner = np.repeat(np.arange(len(firsts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = firsts[owner] + number * LANE
    return at, np.minimum(at + LANE, ends[owner])


class Matcher:
    """All windows of a block of the benchmark."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            width = min(window, len(words))
            for at in range(len(words) - width + 1 if words else 0):
                owners[width][b" ".join(words[at : at + width])].add(item)
        self.lengths = [(WindowsOfLength(n, sorted(found)), found) for n, found in sorted(owners.items())]

    def search(self, part: Slice) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: number of words, runs of hit words, ids of items hit."""
        data = LOWER[part.data]
        starts, ends, bounds = word_spans(data, part.offsets, ALNUM)
        hit = np.zeros(len(starts) + 1, bool)
        items: dict[int, set[str]] = defaultdict(set)
        prefix = Prefix(word_hashes(data, starts, ends))
        for tables, owners in self.lengths:
            width = tables.length
            for end, bucket in tables.stops(prefix, bounds):
                span = range(end - width + 1, end + 1)
                words = b" ".join([data[starts[i] : ends[i]].tobytes() for i in span])
                for number in bucket:
                    if tables.windows[number] == words:
                        hit[span.start : span.stop] = True
                        text = int(np.searchsorted(bounds, end, "right")) - 1
                        items[text] |= owners[words]
        for text, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            runs = []
            if text in items:
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False])).astype(np.int8)))
                runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            yield b - a, runs, sorted(items.get(text, ()))


def _scan(block: list[tuple[str, str]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, window)
        for part in slices(batches):
            n_words, runs, items = zip(*matcher.search(part), strict=True)
            runs = [[{"lo": a, "hi": b} for a, b in r] for r in runs]
            keys = [part.column(c) for c in ("doc_id", "id_key", "text_key")]
            yield record_batch(_SCHEMA, *keys, list(n_words), runs, list(items))

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items with id and text in blocks of about ``block_bytes``; at least one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words")).dropna()
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for number in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        yield [tuple(row) for row in chosen.collect()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, id_key, text_key, n_words, runs, items`` of every document.

    ``runs`` are disjoint ranges of hit words in order, ``items`` the ids of
    the items with an occurring window, sorted.
    """
    texts = keyed_text(docs)
    found = [texts.mapInArrow(_scan(block, window), SCAN) for block in item_blocks(benchmark, block_bytes)]
    blocks = len(found)
    if blocks == 1:
        return found[0]
    keys = ["doc_id", "id_key", "text_key", "n_words"]
    merged = (
        reduce(DataFrame.unionAll, found)
        .groupBy(*keys)
        .agg(
            (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
            F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    )
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*keys, "runs", "items")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, whole, without any hit; block after block, never shuffled."""
    for block in item_blocks(benchmark, block_bytes):
        docs = _without(docs, block, window)
    return docs


def _without(docs: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    def chooser():
        matcher = Matcher(block, window)
        return lambda part: [not items for _, _, items in matcher.search(part)]

    return passing(docs, chooser)


def _covered(runs: str) -> F.Column:
    """Words in the union of sorted runs."""
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        runs,
        empty,
        lambda seen, run: F.struct(
            F.greatest(seen["end"], run["hi"]).alias("end"),
            (seen["total"] + F.greatest(F.lit(0).cast("long"), run["hi"] - F.greatest(seen["end"], run["lo"]))).alias(
                "total"
            ),
        ),
        lambda seen: seen["total"],
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, hit words, items hit, their digest, verdict."""
    counted = hits(docs, benchmark, window, block_bytes).withColumn("n_hit", _covered("runs"))
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
