"""Suffix-array dedup: maximal repeats from the interval tree of common prefixes.

Texts are UTF-8 bytes.  Stretches whose windows of ``window`` bytes share a
minimiser are dealt to its bucket as strings (``superkmers``); a bucket's strings
are the texts of one *enhanced suffix array*, each ended by a sentinel of its own.
In a bucket

* suffixes are grouped by their first ``window`` bytes, and a group whose
  members are all preceded by the same byte is passed over: its repeat goes on to
  the left, and the longer one is met there;
* the others are sorted, their neighbours' common prefixes are measured on the
  bytes, and one scan with a stack over these lengths gives the tree of
  intervals, each a repeat with *all* its occurrences as a range of ranks;
* intervals whose members are preceded by different bytes (or by a string's
  beginning) are kept: they cannot be extended to either side.

A repeat longer than a bucket's strings appears as overlapping repeats of
neighbouring buckets; ``removed_spans`` joins them.  Their union is exactly the
bytes covered by a window that occurs twice.

Defined results: a NULL text has no bytes; matches never cross texts; a text
shorter than ``window`` has none; a repeated row repeats all its windows; a
missing doc_id is a value like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, keyed_text, record_batch, slices
from .superkmers import KEYS, Repeats, Scheme, distinct_rows, in_buckets, repeats, step_edges

BYTES = Scheme(window=400, k=64, words=False)

#: windows of a bucket that are sorted at a time
STEP_WINDOWS = 1 << 19
#: precedes a string's first suffix, and is unlike any byte and itself
OPEN = -1

SUFFIXES = (
    "array long, rank int, minimiser long, content long, at int, longest int, "
    "intervals array<struct<length:int,last:int>>"
)
_SUFFIXES = pa.schema(
    [
        ("array", pa.int64()),
        ("rank", pa.int32()),
        ("minimiser", pa.int64()),
        ("content", pa.int64()),
        ("at", pa.int32()),
        ("longest", pa.int32()),
        ("intervals", pa.list_(pa.struct([("length", pa.int32()), ("last", pa.int32())]))),
    ]
)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def prefix_intervals(lengths: list[int], before: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """The tree of common-prefix intervals: ``(length, first, last, preceding)``.

    ``lengths[i]`` is the common prefix of suffixes i and i+1.  ``preceding`` is
    the byte before all members, or ``OPEN`` if they differ.
    """
    stack = [(0, 0, None)]
    for i, length in enumerate([*lengths, 0]):
        first, left = i, before[i]
        while stack[-1][0] > length:
            depth, first, seen = stack.pop()
            left = _alike(seen, left)
            yield depth, first, i, left
        if length > stack[-1][0]:
            stack.append((length, first, left))
        else:
            depth, low, seen = stack.pop()
            stack.append((depth, low, _alike(seen, left)))


def _alike(a: int | None, b: int) -> int:
    return b if a is None or a == b else OPEN


def maximal_repeats(suffixes: list[tuple[bytes, int, int]], window: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """For sorted ``(suffix, preceding byte, copies)``: each suffix's longest maximal
    repeat, and all maximal repeats ``(length, first, last)``."""
    longest = [0] * len(suffixes)
    found = []
    for i, (text, before, copies) in enumerate(suffixes):
        if copies > 1 and before == OPEN and len(text) >= window:
            found.append((len(text), i, i))
            longest[i] = len(text)
    lengths = [common_prefix(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    for length, first, last, left in prefix_intervals(lengths, [s[1] for s in suffixes]):
        if length >= window and left == OPEN:
            found.append((length, first, last))
            for i in range(first, last + 1):
                longest[i] = max(longest[i], length)
    return longest, found


def _heads(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """The hash of every window of every string, a step's bytes at a time."""
    edges = step_edges(sizes, np.arange(1, len(sizes) + 1))
    heads = []
    for a, b in zip(edges, edges[1:], strict=False):
        first, counts = begins[a], sizes[a:b] - window + 1
        opens = np.repeat(begins[a:b] - first - (np.cumsum(counts) - counts), counts)
        hashes = Prefix(data[first : begins[b - 1] + sizes[b - 1]]).windows(window)
        heads.append(hashes[opens + np.arange(len(opens))])
    return np.concatenate(heads)


def _scan(scheme: Scheme, step: int = STEP_WINDOWS):
    window = scheme.window

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = distinct_rows(table)
        packed = table.column("packed").to_pylist()
        names = tuple(table.column(c).to_numpy() for c in ("minimiser", "content", "copies"))
        sizes = np.array([len(p) for p in packed])
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(packed), np.uint8)
        heads = _heads(data, begins, sizes, window)
        closes = np.cumsum(sizes - window + 1)
        classes = -(-len(heads) // step)
        for number in range(classes):  # equal windows are in one class
            windows = np.arange(len(heads)) if classes == 1 else np.flatnonzero(heads % np.uint64(classes) == number)
            owner = np.searchsorted(closes, windows, "right")
            at = windows - closes[owner] + sizes[owner] - window + 1
            before = np.where(at > 0, data[np.maximum(begins[owner] + at - 1, 0)].astype(np.int64), OPEN)
            rows = _arrays(packed, names, owner, at, before, heads[windows], window)
            if rows:
                yield record_batch(_SUFFIXES, *map(list, zip(*rows, strict=True)))

    return work


def _arrays(packed: list[bytes], names: tuple, owner, at, before, head, window: int) -> list[tuple]:
    """The rows of ``suffix_arrays`` for windows given by string, place, byte before and hash."""
    if not len(head):
        return []
    minimiser, content, copies = names
    order = np.argsort(head, kind="stable")
    opens = np.flatnonzero(np.concatenate(([True], head[order][1:] != head[order][:-1])))
    left = before[order]
    often = np.add.reduceat(copies[owner[order]], opens) > 1
    low, high = np.minimum.reduceat(left, opens), np.maximum.reduceat(left, opens)
    chosen = np.flatnonzero(often & ((low == OPEN) | (low != high)))
    ends = np.append(opens[1:], len(order))

    rows: list[tuple] = []
    for group in chosen.tolist():
        members = []
        for i in order[opens[group] : ends[group]].tolist():
            text = packed[owner[i]]
            members.append((text[at[i] :], int(before[i]), int(copies[owner[i]]), int(owner[i]), int(at[i])))
        members.sort()
        longest, found = maximal_repeats([m[:3] for m in members], window)
        starts: dict[int, list[dict]] = {}
        for length, first, last in found:
            starts.setdefault(first, []).append({"length": length, "last": last})
        array = int(head[order[opens[group]]].view(np.int64))
        for rank, (member, most) in enumerate(zip(members, longest, strict=True)):
            if most or rank in starts:
                _, _, _, string, offset = member
                rows.append((array, rank, minimiser[string], content[string], offset, most, starts.get(rank, [])))
    return rows


def suffix_arrays(found: Repeats) -> DataFrame:
    """The sorted suffixes that begin maximal repeats, with their interval tree.

    ``array`` and ``rank`` place a suffix, ``minimiser, content, at`` say which
    string it is in and where, ``longest`` is its longest maximal repeat, and
    ``intervals`` are the maximal repeats whose first occurrence in order it is:
    their length and the rank of their last occurrence.
    """
    return in_buckets(found.strings, _scan(found.scheme), SUFFIXES)


def repeat_groups(docs: DataFrame, scheme: Scheme = BYTES) -> tuple[DataFrame, DataFrame]:
    """Maximal repeats and their occurrences.

    The first frame has one row ``array, first, last, length`` per repeat, the
    second ``array, rank, id_key, text_key, start`` per occurrence; a repeat's
    occurrences are those with ranks ``first`` to ``last`` of its array, so that
    nested repeats share them.
    """
    found = repeats(docs, scheme)
    arrays = suffix_arrays(found)
    groups = arrays.select("array", F.col("rank").alias("first"), F.inline("intervals")).select(
        "array", "first", "last", "length"
    )
    places = arrays.join(found.runs, ["minimiser", "content"]).select(
        "array", "rank", *KEYS, (F.col("start") + F.col("at")).alias("start")
    )
    return groups, places


def removed_spans(found: Repeats) -> DataFrame:
    """``id_key, text_key, spans``: the byte ranges that repeats cover, unmerged."""
    start = F.col("start") + F.col("at")
    return (
        found.runs.join(suffix_arrays(found).where("longest > 0"), ["minimiser", "content"])
        .groupBy(*KEYS)
        .agg(F.collect_set(F.struct(start.alias("lo"), (start + F.col("longest")).alias("hi"))).alias("spans"))
    )


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """A mask of the bytes that spans cover."""
    edges = np.zeros(n + 1, np.int32)
    for span in spans:
        edges[span["lo"]] += 1
        edges[span["hi"]] -= 1
    return np.cumsum(edges)[:-1] > 0


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The mask without characters of which only some bytes are covered."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(begins):
        return gone
    all_gone = np.logical_and.reduceat(gone, begins)
    return np.repeat(all_gone, np.diff(np.append(begins, len(raw))))


RESULT = "id_key long, text_key long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema(
    [
        ("id_key", pa.int64()),
        ("text_key", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
)
KEPT = "id_key long, text_key long, kept string"
_KEPT = pa.schema([("id_key", pa.int64()), ("text_key", pa.int64()), ("kept", pa.string())])


def _masks(part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, spans in zip(part.texts(), part.column("spans").to_pylist(), strict=True):
        raw = np.frombuffer(text, np.uint8)
        yield raw, covered(len(raw), spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        removed, spans, digests = [], [], []
        for raw, gone in _masks(part):
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digests.append(sha256(raw[~gone].tobytes()).hexdigest())
        yield record_batch(_RESULT, part.column("id_key"), part.column("text_key"), removed, spans, digests)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        kept = [raw[~whole_characters(raw, gone)].tobytes().decode() for raw, gone in _masks(part)]
        yield record_batch(_KEPT, part.column("id_key"), part.column("text_key"), kept)


def _concerned(docs: DataFrame, scheme: Scheme) -> DataFrame:
    found = repeats(docs, scheme)
    return found.texts.join(removed_spans(found), KEYS).select(*KEYS, "text", "spans")


def without_repeats(docs: DataFrame, scheme: Scheme = BYTES) -> DataFrame:
    """``id_key, text_key, kept``: the remaining text of every document that loses any.

    Characters go as a whole or stay.
    """
    return _concerned(docs, scheme).mapInArrow(_cut, KEPT).dropDuplicates(KEYS)


def report(docs: DataFrame, scheme: Scheme = BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    shortened = _concerned(docs, scheme).mapInArrow(_digest, RESULT).dropDuplicates(KEYS)
    text = F.coalesce("text", F.lit(""))
    whole = keyed_text(docs).select(
        "doc_id", *KEYS, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256")
    )
    none = F.lit(0).cast("long")
    return whole.join(shortened, KEYS, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )
