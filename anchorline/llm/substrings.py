"""Substring dedup by super-k-mer partitioning, over words.

A window is ``window`` consecutive words.  Consecutive windows with one minimiser
travel as one packed string to that minimiser's bucket (``superkmers``), where
the windows of all strings are sorted, so that equal ones meet and are counted
exactly, word for word.  A window that also starts in a document with a smaller
id is a repeat; all words that repeats cover are removed.

Defined results: a NULL, empty or blank text has no words; the windows of a text
with fewer than ``window`` words do not exist; a row without a doc_id counts as
the last; rows of one id are no repeats of each other; repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, record_batch, slices
from .superkmers import KEYS, Repeats, Scheme, distinct_rows, in_buckets, repeats

WORDS = Scheme(window=50, k=8, words=True)

#: bytes of windows of a bucket that are sorted at a time
STEP_WINDOW_BYTES = 1 << 26

FIRSTS = "minimiser long, content long, lo int, hi int, seen long, first_id long"
_FIRSTS = pa.schema(
    [
        ("minimiser", pa.int64()),
        ("content", pa.int64()),
        ("lo", pa.int32()),
        ("hi", pa.int32()),
        ("seen", pa.int64()),
        ("first_id", pa.int64()),
    ]
)


def count_windows(
    strings: list[bytes], copies: list[int], ids: list[int], window: int, step: int = STEP_WINDOW_BYTES
) -> Iterator[tuple]:
    """Runs ``(string, lo, hi, seen, first id)`` of the windows of one bucket's strings.

    Windows of a string that occur equally often and first in the same document
    make one run; windows that occur once are left out.  About ``step`` bytes of
    windows are sorted at a time.
    """
    begins = [
        [0, *(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32) + 1).tolist(), len(packed) + 1] for packed in strings
    ]
    load = sum((len(b) - window) * len(packed) for b, packed in zip(begins, strings, strict=True))
    classes = max(1, -(-load // step))
    found = []
    for chosen in range(classes):  # equal windows are in one class
        windows = []
        for number, (packed, edges) in enumerate(zip(strings, begins, strict=True)):
            for at in range(len(edges) - window):
                text = packed[edges[at] : edges[at + window] - 1]
                if classes == 1 or crc32(text) % classes == chosen:
                    windows.append((text, number, at))
        windows.sort()
        for _, same in groupby(windows, key=itemgetter(0)):
            places = [(number, at) for _, number, at in same]
            owners = {number for number, _ in places}
            seen = sum(copies[number] for number, _ in places)
            if seen > 1:
                first = min(ids[number] for number in owners)
                found.extend((number, at, seen, first) for number, at in places)
    found.sort()
    run = None
    for number, at, seen, first in found:
        if run and run[0] == number and run[2] == at and run[3:] == (seen, first):
            run = (number, run[1], at + 1, seen, first)
        else:
            if run:
                yield run
            run = (number, at, at + 1, seen, first)
    if run:
        yield run


def _count(scheme: Scheme):
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = distinct_rows(table)
        keys = table.column("minimiser").to_numpy()
        contents, copies, ids, packed = (table.column(c).to_pylist() for c in ("content", "copies", "first_id", "packed"))
        edges = np.flatnonzero(np.diff(keys)) + 1
        rows = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
            if b - a == 1 and copies[a] == 1:
                continue
            for number, lo, hi, seen, first in count_windows(packed[a:b], copies[a:b], ids[a:b], scheme.window):
                rows.append((keys[a], contents[a + number], lo, hi, seen, first))
        if rows:
            yield record_batch(_FIRSTS, *map(list, zip(*rows, strict=True)))

    return work


def repeated_windows(found: Repeats) -> DataFrame:
    """Counts of the windows that occur more than once, as runs within strings."""
    return in_buckets(found.strings, _count(found.scheme), FIRSTS)


RESULT = "id_key long, text_key long, n_removed long, kept_sha256 string"
_RESULT = pa.schema(
    [("id_key", pa.int64()), ("text_key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
)
BASE = "doc_id long, id_key long, text_key long, n_words long, whole_sha256 string"
_BASE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("id_key", pa.int64()),
        ("text_key", pa.int64()),
        ("n_words", pa.int64()),
        ("whole_sha256", pa.string()),
    ]
)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        removed, digests = [], []
        for text, spans in zip(part.texts(), part.column("spans").to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int32)
            for span in spans:
                gone[span["lo"]] += 1
                gone[span["hi"]] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            kept = [word for word, stay in zip(words, stays.tolist(), strict=True) if stay]
            removed.append(len(words) - len(kept))
            digests.append(sha256(b" ".join(kept)).hexdigest())
        yield record_batch(_RESULT, part.column("id_key"), part.column("text_key"), removed, digests)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        split = [text.split() for text in part.texts()]
        keys = [part.column(name) for name in ("doc_id", *KEYS)]
        yield record_batch(
            _BASE, *keys, [len(words) for words in split], [sha256(b" ".join(words)).hexdigest() for words in split]
        )


def removed_spans(found: Repeats) -> DataFrame:
    """Word ranges to remove, ``id_key, text_key, spans``, of every document with any."""
    last = found.scheme.window - 1
    return (
        found.runs.join(repeated_windows(found), ["minimiser", "content"])
        .where("first_id < id_key")
        .groupBy(*KEYS)
        .agg(
            F.collect_set(
                F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + last).alias("hi"))
            ).alias("spans")
        )
    )


def report(docs: DataFrame, scheme: Scheme = WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    found = repeats(docs, scheme)
    shortened = found.texts.join(removed_spans(found), KEYS).select(*KEYS, "text", "spans").mapInArrow(_keep, RESULT)
    whole = keyed_text(docs).mapInArrow(_whole, BASE)
    return whole.join(shortened.dropDuplicates(KEYS), KEYS, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )
