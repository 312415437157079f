"""Document fingerprints from closed syncmers.

A k-mer of code points is a *closed syncmer* if the smallest of the hashed
s-mers inside it is its first or its last.  That depends on the k-mer alone, so
an edit disturbs only the k-mers that contain it, and the chosen k-mers are
anchors that two texts can be matched on by position.

A fingerprint holds all anchors of a text (first place of each), so it grows with
the text.  The likeness of two is the longest chain of common anchors that lie in
the same order in both, over the anchors of their union: the Jaccard index of the
anchors, less what only moved text shares.  It is printed with bounded length, in
hex: a 64-bit digest of all anchors, then the ``size`` ones with the smallest
hashes as ``position, hash`` pairs of 32 bits, in order of position.

Defined results: a NULL or empty text has the empty fingerprint, which is like
itself (1) and like nothing else (0); a text with no chosen k-mer has one anchor,
its own hash; equal texts have equal fingerprints; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, parallelism, record_batch

K, S, SIZE = 16, 6, 128
#: A missing doc_id comes last in descending order.
LAST = -(1 << 63)

_ANCHOR = np.dtype([("position", ">u4"), ("hash", ">u4")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    out, reach = x, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = Prefix(points)
    at = np.zeros(0, np.int64)
    if len(points) >= k:
        inner = prefix.windows(s)
        least = sliding_min(inner, k - s + 1)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    if not len(at):
        return np.zeros(1, np.int64), prefix.spans(np.array([0]), np.array([len(points)]))
    return at, prefix.spans(at, at + k)


class Fingerprint:
    """The anchors of a text; ``size`` of them are printed."""

    def __init__(self, text: str | None, size: int = SIZE):
        at, found = syncmers(text or "")
        self.hashes, first = np.unique((found >> np.uint64(32)).astype(np.uint32), return_index=True)
        self.size, self.positions = size, at[first]

    def __str__(self) -> str:
        if not len(self.hashes):
            return ""
        every = self._pairs(len(self.hashes))
        return sha256(every).hexdigest()[:16] + self._pairs(self.size).hex()

    def _pairs(self, size: int) -> bytes:
        """The anchors with the smallest hashes, in order of position."""
        pairs = np.empty(min(size, len(self.hashes)), _ANCHOR)
        order = np.argsort(self.positions[:size], kind="stable")
        pairs["position"], pairs["hash"] = self.positions[:size][order], self.hashes[:size][order]
        return pairs.tobytes()

    def likeness(self, other: Fingerprint) -> float:
        if not len(self.hashes) or not len(other.hashes):
            return float(len(self.hashes) == len(other.hashes))
        common, mine, yours = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        union = len(self.hashes) + len(other.hashes) - len(common)
        order = np.argsort(self.positions[mine], kind="stable")
        return chain(other.positions[yours][order].tolist()) / union


def chain(positions: list[int]) -> int:
    """Length of the longest increasing chain."""
    tails: list[int] = []
    for position in positions:
        at = bisect_left(tails, position)
        tails[at : at + 1] = [position]
    return len(tails)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the next."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, halo`` dealt and sorted so that each row is followed by its next.

    Descending doc_id (a missing one last), rows of one id by text.  Ranges of
    ids are cut at ids of the table.  The first rows of a range are sent to the
    range before as well, marked ``halo``; the first of all also follow the last.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("order"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ranges = max(1, parallelism(spark))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    found = rows.agg(F.percentile_approx("order", shares, max(10_000, 20 * ranges)), F.max("order")).first()
    cuts = np.array(sorted(set(found[0] or ())), np.int64)
    first = found[1]

    @F.pandas_udf("range int, opens boolean")
    def placed(order: pd.Series) -> pd.DataFrame:
        values = order.to_numpy(np.int64)
        at = np.searchsorted(cuts, values, "left")
        opens = np.append(cuts, LAST)[at] == values
        return pd.DataFrame({"range": len(cuts) - at, "opens": opens & (at < len(cuts))})

    def copy(where, halo: int):
        return F.struct(where.cast("int").alias("range"), F.lit(halo).alias("halo"))

    own, before, wrapped = copy(F.col("at.range"), 0), copy(F.col("at.range") - 1, 1), copy(F.lit(len(cuts)), 2)
    copies = F.array(
        own,
        F.when(F.col("at.opens"), before),
        F.when(F.col("order") == F.lit(first), wrapped) if first is not None else F.lit(None).cast("struct<range:int,halo:int>"),
    )
    return (
        rows.withColumn("at", placed("order"))
        .withColumn("copy", F.explode(F.array_compact(copies)))
        .select("doc_id", "order", "text", "copy.range", "copy.halo")
        .repartitionById(len(cuts) + 1, F.col("range"))
        .sortWithinPartitions(F.col("halo") == 2, F.col("order").desc(), "text", "halo")
        .select("doc_id", "text", "halo")
    )


REPORT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row that waits for its next
    out: list[tuple] = []
    for batch in batches:
        for doc_id, text, halo in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            mark = Fingerprint(text)
            if held is not None:
                out.append(_compared(*held, text, mark))
            held = None if halo else (doc_id, text, mark)
        if out:
            yield record_batch(_SCHEMA, *map(list, zip(*out, strict=True)))
            out = []


def _compared(doc_id, text: str, mark: Fingerprint, following: str, next_mark: Fingerprint) -> tuple:
    changed = edited(text, following)
    other = Fingerprint(changed)
    digest = sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, str(mark), str(other), mark.likeness(other), mark.likeness(next_mark)


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    return with_next(docs).mapInArrow(_compare, REPORT)
