"""Periodic runs of words, found by tiles of one period octave each.

A *run* is a stretch of consecutive words with smallest period q, of at least
``max(least, exponent * q)`` words, that no neighbouring word extends.

1. Words become 64-bit hashes.  Where words i and i + q agree, period q *matches* at i;
   a run of period q is a maximal stretch of at least ``(exponent - 1) * q`` matches.
2. Periods are taken by octaves [P, 2P).  The document is tiled with an anchor at every
   second P-th word; a tile reaches 2P matches to either side of its anchor, so
   neighbouring tiles overlap and each long enough stretch holds an anchor.  A tile asks
   for every q of its octave how far matches go on from the anchor and how far back: the
   Z-function of the text after the anchor and that of the reversed text before it, at
   q.  They are looked up by doubling on prefix hashes, for all tiles of a slice of the
   texts at once; the work on n words is n / 2 comparisons an octave.
3. A stretch that ends inside its tile is whole, one that reaches the tile's edge is a
   fragment.  Both are rows (document, period, first, end), shuffled by document and
   period; overlapping ones are stitched.  Only the smallest period of a stretch leaves
   its tile: the period's first words must not be a power of a shorter word.
4. Documents with runs come together with them again, by document, and their words are
   collapsed; a document without any is finished in the first pass.

Nothing but match rows and the texts of documents with runs is shuffled, and equal rows
of match are combined before.  A task holds a slice of texts, or one long text.

Defined results: a NULL or empty text has no words and no runs; a missing doc_id is a
value of its own, whose text is never edited; rows of one id are documents of their own
and equal rows get equal results; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, Prefix, Slice, record_batch, ship, slices, stage, word_hashes, word_spans

#: Fixed values of the query's edited texts.
EDIT_SHARE, EDIT_BASE, EDIT_TURNS = 10, 3, 8


@dataclass(frozen=True)
class Rule:
    """Fewest words of a run, and fewest repetitions of its period."""

    least: int = 6
    exponent: int = 4

    def matches(self, q: np.ndarray) -> np.ndarray:
        """The fewest matches of a run of period q."""
        return np.maximum(self.least - q, (self.exponent - 1) * q)


class Words:
    """The words of a slice of texts, each text with its own order of them.

    ``source`` gives for each place of the edited texts the word that stands there.
    """

    def __init__(self, part: Slice, edit: Callable[[int | None, int], np.ndarray | None] | None = None):
        starts, ends, self.bounds = word_spans(part.data, part.offsets, NOT_SPACE)
        source = np.arange(len(starts))
        if edit is not None:
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
                order = edit(doc_id, b - a)
                if order is not None:
                    source[a:b] = a + order
        hashes = word_hashes(part.data, starts, ends)[source]
        self.starts, self.ends, self.data, self.source = starts, ends, part.data, source
        self.prefix, self.hashes = Prefix(hashes), hashes

    def joined(self, a: int, b: int, kept: np.ndarray | None = None) -> bytes:
        """The words of places a to b, or the ``kept`` ones of them, by single spaces."""
        word = self.source[a:b] if kept is None else self.source[a:b][kept]
        raw = self.data
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.starts[word].tolist(), self.ends[word].tolist(), strict=True)])


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's edit: from a word on, one document of ten repeats a period."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % EDIT_SHARE:
        return None
    g = h // EDIT_SHARE
    a = g % n
    p = 1 + (n - a) // (EDIT_BASE + g % EDIT_TURNS)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _agreeing(prefix: Prefix, at: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Z-values: the matches of period q from each place on, or before it, up to ``most``."""
    found = np.zeros(len(at), np.int64)
    if not len(at):
        return found
    step = 1 << max(0, int(most.max()).bit_length() - 1)
    while step:
        going = np.flatnonzero(found + step <= most)
        lo = at[going] - found[going] - step if back else at[going] + found[going]
        same = prefix.spans(lo, lo + step) == prefix.spans(lo + q[going], lo + q[going] + step)
        found[going[same]] += step
        step >>= 1
    return found


def _primitive(prefix: Prefix, first: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from each place on are no power of a shorter word."""
    alive = np.ones(len(q), bool)
    left, prime = q.copy(), 2
    while len(left) and prime * prime <= int(left.max()) or prime == 2:
        divides = np.flatnonzero((left % prime == 0) & (left > 1))
        if len(divides):
            alive[divides] &= ~_has_period(prefix, first[divides], q[divides], q[divides] // prime)
            while len(divides):
                left[divides] //= prime
                divides = divides[left[divides] % prime == 0]
        prime += 1 + (prime > 2)
    rest = np.flatnonzero(left > 1)  # at most one larger prime each
    alive[rest] &= ~_has_period(prefix, first[rest], q[rest], q[rest] // left[rest])
    return alive


def _has_period(prefix: Prefix, first: np.ndarray, width: np.ndarray, d: np.ndarray) -> np.ndarray:
    return prefix.spans(first, first + width) == prefix.spans(first + d, first + d + width)


def stretches(words: Words, rule: Rule, pairs_at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First match, end of matches and period of every stretch and fragment, by octave."""
    bounds, w, prefix = words.bounds, words.hashes, words.prefix
    longest = int(np.diff(bounds).max(initial=0))
    octave = 1
    while rule.exponent * octave <= longest:
        long = np.flatnonzero(np.diff(bounds) >= max(rule.least, rule.exponent * octave))
        tiles = -(-np.diff(bounds)[long] // (2 * octave))
        owner = np.repeat(long, tiles)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        anchors = bounds[owner] + 2 * octave * number
        step = max(1, pairs_at_once // octave)
        for at in range(0, len(anchors), step):
            yield from _tiles(w, prefix, bounds, anchors[at : at + step], owner[at : at + step], octave, rule)
        octave *= 2


def _tiles(w, prefix, bounds, anchors, owner, octave, rule):
    begin, end = bounds[owner], bounds[owner + 1]
    periods = np.arange(octave, 2 * octave)
    other = anchors[:, None] + periods
    inside = other < end[:, None]
    hit = w[np.minimum(other, len(w) - 1)] == w[anchors][:, None]
    tile, column = np.nonzero(hit & inside)
    c, q, lo, hi = anchors[tile], periods[column], begin[tile], end[tile]

    def matches(shift: int) -> np.ndarray:
        at = c + shift
        found = (at >= lo) & (at + q < hi)
        found[found] = w[at[found]] == w[at[found] + q[found]]
        return found

    # a run has three matches in a row at least, one of them at its anchor
    before, after = matches(-1), matches(1)
    near = np.flatnonzero(before & after | after & matches(2) | before & matches(-2))
    c, q, lo, hi = c[near], q[near], lo[near], hi[near]
    reach = 2 * octave
    ahead = _agreeing(prefix, c, q, np.minimum(reach, hi - q - c), False)
    behind = _agreeing(prefix, c, q, np.minimum(reach, c - lo), True)
    open_end = (ahead == reach) | (behind == reach)
    kept = np.flatnonzero(open_end | (ahead + behind >= rule.matches(q)))
    first, last, q = (c - behind)[kept], (c + ahead)[kept], q[kept]
    whole = last - first >= q  # what is shorter has no whole period to look at
    first, last, q = first[whole], last[whole], q[whole]
    own = _primitive(prefix, first, q)
    if own.any():
        yield first[own], last[own], q[own]


_RUN = pa.struct([("q", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
FOUND = "doc_id long, text_key long, n long, collapsed string, text string, parts array<struct<q: long, lo: long, hi: long>>"
_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n", pa.int64()),
        ("collapsed", pa.string()),
        ("text", pa.string()),
        ("parts", pa.list_(_RUN)),
    ]
)


def _solved(rule: Rule, edit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part, edit)
            bounds = words.bounds
            found = list(stretches(words, rule))
            lo, hi, q = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
            owner = np.searchsorted(bounds, lo, "right") - 1
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(part) + 1))
            parts, collapsed, texts = [], [], []
            raw = list(part.texts())
            for i in range(len(part)):
                own = order[cuts[i] : cuts[i + 1]]
                a, b = int(bounds[i]), int(bounds[i + 1])
                if len(own):
                    rows = zip(q[own].tolist(), (lo[own] - a).tolist(), (hi[own] - a).tolist(), strict=True)
                    parts.append([{"q": x, "lo": y, "hi": z} for x, y, z in rows])
                    collapsed.append(None)
                    texts.append(raw[i].decode())
                else:
                    parts.append(None)
                    collapsed.append(sha256(words.joined(a, b)).hexdigest())
                    texts.append(None)
            yield record_batch(
                _FOUND, part.column("doc_id"), part.column("text_key"), np.diff(bounds), collapsed, texts, parts
            )

    return run


def stitched(found: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, text_key, start, length, period`` of every run."""
    keys = ["doc_id", "text_key", "q"]
    parts = found.where("parts is not null").select("doc_id", "text_key", F.inline("parts")).distinct()
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    seen = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("lo") <= F.col("seen"), 0).otherwise(1)
    numbered = parts.withColumn("seen", seen).withColumn("run", F.sum(opens).over(order))
    runs = numbered.groupBy(*keys, "run").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    runs = runs.withColumn("length", F.col("hi") - F.col("start") + F.col("q"))
    long_enough = F.col("length") >= F.greatest(F.lit(rule.least), rule.exponent * F.col("q"))
    return runs.where(long_enough).select("doc_id", "text_key", "start", "length", F.col("q").alias("period"))


COLLAPSED = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_COLLAPSED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
        ("collapsed", pa.string()),
    ]
)


def _collapsed(edit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part, edit)
            column = part.column("runs")
            digests = []
            for i, runs in enumerate(column.to_pylist()):
                a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                kept = np.ones(b - a, bool)
                for r in runs or ():
                    kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
                digests.append(sha256(words.joined(a, b, kept)).hexdigest())
            yield record_batch(_COLLAPSED, part.column("doc_id"), column.cast(_COLLAPSED.field("runs").type), digests)

    return run


def documents(docs: DataFrame, rule: Rule = Rule(), edit=None) -> DataFrame:
    """``doc_id, runs, collapsed``: every document's runs by start and period, and the digest of its kept words.

    ``edit`` is ``(doc_id, n) -> order of the words`` or None for those as they stand.
    """
    ship(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = stage(keyed.mapInArrow(_solved(rule, edit), FOUND), "stretches")
    runs = stitched(found, rule)
    each = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    listed = runs.groupBy("doc_id", "text_key").agg(each.alias("runs"))
    listed = listed.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])))
    listed = listed.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "runs")
    some = found.where("parts is not null").select("doc_id", "text_key", "text")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    with_runs = some.join(listed, same, "left").select("doc_id", "text", "runs")
    empty = F.lit(None).cast(COLLAPSED.split(" runs ")[1].split(", collapsed")[0])
    none = found.where("parts is null").select("doc_id", empty.alias("runs"), "collapsed")
    return with_runs.mapInArrow(_collapsed(edit), COLLAPSED).unionByName(none)


def report(docs: DataFrame, rule: Rule = Rule(), edit=planted) -> DataFrame:
    """One row per document: number of runs, the longest one, and the digests."""
    runs = F.coalesce("runs", F.array().cast(COLLAPSED.split(" runs ")[1].split(", collapsed")[0]))
    listed = documents(docs, rule, edit).select("doc_id", runs.alias("runs"), "collapsed")
    # the greatest length first, then the smallest start and period
    ranked = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    top = F.array_min(ranked)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return listed.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.col1")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(-top.col1 * 1000) div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
