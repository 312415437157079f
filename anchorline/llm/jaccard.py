"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct shingles of ``words`` words; documents whose sets have
a Jaccard index of at least ``percent`` are linked.  Documents of equal sets are one
*class*, and a linked pair of classes shares one of the rarest n-grams of each: with the
n-grams of a set of n in ascending order of document frequency, one of the first
``n - ceil(percent * n) + 1``, its *prefix*.

1. A slice of the texts sends the n-grams of its classes, packed, to their part of the
   hash space, where frequencies are counted exactly (a class counts once for each slice
   that has it).  N-grams that come once can't be shared: they come first in the order
   and go no further.  The others return to their slice with their frequency.  N-grams in more than a share ``HOT`` of the classes of several slices of
   the texts are named first (there are at most mean set size / ``HOT`` of them); they
   come last in the order and never leave their class, so no part gets a frequent one.
2. A class that shares fewer than ``percent`` of its n-grams has no link.  The others go
   to a bucket for each shared n-gram of their prefix.
3. Pairs of a bucket are joined by ``linking``: a pair formed at one n-gram must pass the
   length filter and the positional filter (what stands before and after the n-gram
   bounds the overlap).  Pairs of a region must pass the length filter, the bound by
   shared n-grams, and the suffix filter: both sets are divided by ``RANGES`` ranges of
   hashes, and the differences of the ranges' sizes bound the overlap.  What is left is
   verified, once for each pair of a region, by the exact intersection.

Defined results: a NULL, empty or blank text has no shingles and is a component of its
own; a text of fewer words than a shingle has one, all its words; each row is a document,
equal sets are linked, whatever their ids; a component without any id has none; other
columns are ignored; an empty table gives no rows.  N-grams are 64-bit hashes, of which
the parts of the hash space keep 48 bits and their own number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism, record_batch, ship, slices, stage, whole_groups
from .linking import linked_roots, named
from .neardup import Rule, node_of, shingle_sets

#: Text that packed rows of n-grams come from, and the most classes of one, as 16 bits number them.
SLICE, CLASSES = 4 << 20, 1 << 16
#: N-grams that one part of the hash space takes, and the most parts.
PER_PART, PARTS = 4_000_000, 1 << 16
#: An n-gram in more than this share of all classes is hot.
HOT = 0.002
#: Classes of one slice that an n-gram is in before the slice reports it as hot.
HOT_IN_SLICE = 8
#: Ranges of hashes of the suffix filter.
RANGES = 256

ROWS = "doc_id long, n long, node long, hot binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("hot", pa.binary())])
_HOT = pa.schema([("gram", pa.int64()), ("classes", pa.int64())])
PACKED = "part int, slice long, own boolean, places binary, grams binary, dfs binary"
_PACKED = pa.schema(
    [
        ("part", pa.int32()),
        ("slice", pa.int64()),
        ("own", pa.bool_()),
        ("places", pa.binary()),
        ("grams", pa.binary()),
        ("dfs", pa.binary()),
    ]
)
SETS = "node long, n long, grams binary, posted array<struct<key: long, pos: long>>"
_SETS = pa.schema(
    [
        ("node", pa.int64()),
        ("n", pa.int64()),
        ("grams", pa.binary()),
        ("posted", pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64())]))),
    ]
)


def _classes_of(part, words: int) -> tuple[list, list, dict[int, np.ndarray]]:
    """Set sizes and nodes of the slice's documents, and the set of every node."""
    sizes, nodes, sets = [], [], {}
    for shingles in shingle_sets(part, words):
        sizes.append(len(shingles))
        nodes.append(node_of(shingles) if len(shingles) else None)
        if len(shingles):
            sets.setdefault(nodes[-1], shingles)
    return sizes, nodes, sets


def _described(rule: Rule):
    """Every document's set size and node; the first row of a slice has its frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, budget=SLICE):
            sizes, nodes, sets = _classes_of(part, rule.words)
            hot = [None] * len(sizes)
            if len(sets) >= HOT_IN_SLICE:
                grams, classes = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                often = classes >= max(HOT_IN_SLICE, HOT * len(sets))
                hot[0] = np.stack([grams[often], classes[often].astype(np.uint64)]).tobytes()
            yield record_batch(_ROWS, part.column("doc_id"), sizes, nodes, hot)

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("hot").to_pylist():
            grams, classes = np.frombuffer(blob, np.uint64).reshape(2, -1)
            yield record_batch(_HOT, grams.view(np.int64), classes.view(np.int64))


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> np.uint64(48)).astype(np.int64) * parts) >> 16


def _six_bytes(grams: np.ndarray) -> bytes:
    return grams.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _sent(rule: Rule, hot: np.ndarray, parts: int):
    """N-grams by part of the hash space, each with its class's place in the slice.

    One more row, marked ``own``, has for the slice itself each class's node, set size
    and number of hot n-grams, and then those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, budget=SLICE):
            _, _, found = _classes_of(part, rule.words)
            every = list(found.items())
            for first in range(0, len(every), CLASSES):
                names, sets = zip(*every[first : first + CLASSES], strict=True)
                names = np.array(names, np.int64)
                number = int.from_bytes(blake2b(names.tobytes(), digest_size=8).digest(), "little", signed=True)
                sizes = np.array([len(s) for s in sets], np.int64)
                grams, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                rank = np.searchsorted(hot, grams)
                is_hot = (hot[np.minimum(rank, len(hot) - 1)] == grams) if len(hot) else np.zeros(len(grams), bool)
                held = np.bincount(place[is_hot], minlength=len(sets))
                own = np.concatenate([names, sizes, held]).tobytes()
                rows = [(number % parts, number, True, own, grams[is_hot].tobytes(), None)]
                cold, place = grams[~is_hot], place[~is_hot].astype(np.uint16)
                at = part_of(cold, parts)
                order = np.argsort(at, kind="stable")
                cold, place, at = cold[order], place[order], at[order]
                cuts = np.flatnonzero(np.diff(at)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                    if a < b:
                        rows.append((int(at[a]), number, False, place[a:b].tobytes(), _six_bytes(cold[a:b]), None))
                yield record_batch(_PACKED, *(list(c) for c in zip(*rows, strict=True)))

    return run


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's n-grams those that come several times, with their frequency, for every slice."""
    for whole in whole_groups(batches, "part"):
        for table in _by_value(whole, "part"):
            own = table.column("own")
            yield from table.filter(own).to_batches()
            table = table.filter(pc.invert(own))
            if not table.num_rows:
                continue
            number = table.column("part")[0].as_py()
            row = np.repeat(np.arange(table.num_rows), [len(g) // 6 for g in table.column("grams").to_pylist()])
            places = np.frombuffer(_joined(table.column("places")), np.uint16)
            grams = _from_six_bytes(_joined(table.column("grams")))
            order = np.argsort(grams, kind="stable")
            run = np.diff(np.flatnonzero(np.diff(grams[order], prepend=~grams[order][:1])), append=len(grams))
            df = np.empty(len(grams), np.uint32)
            df[order] = np.repeat(run, run)
            shared = df > 1
            row, places, grams, df = row[shared], places[shared], grams[shared], df[shared]
            cuts = np.searchsorted(row, np.arange(table.num_rows + 1)).tolist()
            rows = [
                (number, slice_id, False, places[a:b].tobytes(), _six_bytes(grams[a:b]), df[a:b].tobytes())
                for slice_id, a, b in zip(table.column("slice").to_pylist(), cuts[:-1], cuts[1:], strict=True)
                if a < b
            ]
            if rows:
                yield record_batch(_PACKED, *(list(c) for c in zip(*rows, strict=True)))


def _by_value(table: pa.Table, column: str) -> Iterator[pa.Table]:
    values = table.column(column).to_numpy()
    cuts = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
        yield table.slice(a, b - a)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n shares at least with any linked one."""
    return -(-n * percent // 100)


def _assembled(rule: Rule, hot: np.ndarray, hot_df: np.ndarray):
    """Of every class of a slice that can have a link: its shared n-grams, and those of its prefix with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "slice"):
            for table in _by_value(whole, "slice"):
                own = table.filter(table.column("own"))  # of slices with the same classes one is enough
                names, sizes, held = np.frombuffer(own.column("places")[0].as_py(), np.int64).reshape(3, -1)
                late = np.frombuffer(own.column("grams")[0].as_py(), np.uint64)
                table = table.filter(pc.invert(table.column("own")))
                count = [len(g) // 6 for g in table.column("grams").to_pylist()]
                part = np.repeat(table.column("part").to_numpy().astype(np.uint64), count) << np.uint64(48)
                grams = np.concatenate([_from_six_bytes(_joined(table.column("grams"))) | part, late])
                place = np.concatenate([np.frombuffer(_joined(table.column("places")), np.uint16), np.repeat(np.arange(len(names)), held)])
                df = np.concatenate([np.frombuffer(_joined(table.column("dfs")), np.uint32), hot_df[np.searchsorted(hot, late)]])
                last = np.arange(len(grams)) >= len(grams) - len(late)  # the hot ones, whatever their frequency
                order = np.lexsort((grams, df, last, place))
                place, grams = place[order], grams[order]
                new = (np.diff(place, prepend=-1) != 0) | (np.diff(grams, prepend=~grams[:1]) != 0)
                place, grams = place[new], grams[new]
                cuts = np.searchsorted(place, np.arange(len(names) + 1))
                need = least_overlap(sizes, rule.percent)
                rows = []
                for i in np.flatnonzero(np.diff(cuts) >= np.maximum(need, 1)).tolist():
                    mine, n = grams[cuts[i] : cuts[i + 1]], int(sizes[i])
                    alone = n - len(mine)
                    prefix = mine[: max(0, n - int(need[i]) + 1 - alone)].view(np.int64).tolist()
                    posted = [{"key": key, "pos": alone + j} for j, key in enumerate(prefix)]
                    rows.append((int(names[i]), n, np.sort(mine).tobytes(), posted))
                if rows:
                    yield record_batch(_SETS, *(list(c) for c in zip(*rows, strict=True)))

    return run


class Sets:
    """Shared n-grams of some classes inside a task."""

    def __init__(self, rule: Rule, table: pa.Table):
        self.percent = rule.percent
        self.n = table.column("n").to_numpy()
        self.grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        self.shared = np.array([len(g) for g in self.grams], np.int64)
        self.ranges = np.zeros((len(self.n), RANGES), np.int16)
        owner = np.repeat(np.arange(len(self.n)), self.shared)
        if len(owner):
            ranges = (np.concatenate(self.grams) % np.uint64(RANGES)).astype(np.int64)
            places, counts = np.unique(owner * RANGES + ranges, return_counts=True)
            self.ranges.ravel()[places] = np.minimum(counts, 32_000)

    def possible(self, x: np.ndarray, y: np.ndarray, at_once: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        t = self.percent
        n, shared = self.n, self.shared
        total = n[x] + n[y]
        alive = 100 * np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y])
        alive &= (100 + t) * np.minimum(shared[x], shared[y]) >= t * total
        x, y = x[alive], y[alive]
        kept = []
        for at in range(0, len(x), at_once):
            a, b = x[at : at + at_once], y[at : at + at_once]
            total = n[a] + n[b]
            apart = np.abs(self.ranges[a] - self.ranges[b]).sum(1, dtype=np.int64) + total - shared[a] - shared[b]
            kept.append(at + np.flatnonzero((100 + t) * (total - apart) >= 2 * t * total))
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return x[kept], y[kept]

    def prepare(self, rows: np.ndarray) -> None:
        pass

    def linked(self, x: int, y: int) -> bool:
        a, b = self.grams[x], self.grams[y]
        if len(a) > len(b):
            a, b = b, a
        common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * common >= self.percent * (int(self.n[x]) + int(self.n[y]) - common)


@dataclass(frozen=True)
class SetComparer:
    rule: Rule

    columns = ["n", "grams"]

    def load(self, table: pa.Table) -> Sets:
        return Sets(self.rule, table)

    def formed(self, a: str, b: str) -> Column:
        """Length and positional filter at the n-gram where two classes meet."""
        t = self.rule.percent
        n_a, n_b, at_a, at_b = (F.col(c + s) for c in ("n", "pos") for s in (a, b))
        zero = F.lit(0).cast("long")
        most = F.least(n_a - F.greatest(zero, at_a - at_b), n_b - F.greatest(zero, at_b - at_a))
        return (100 * F.least(n_a, n_b) >= t * F.greatest(n_a, n_b)) & ((100 + t) * most >= t * (n_a + n_b))


def hot_grams(described: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The hot n-grams in ascending order, and the classes that slices reported of them."""
    rows = described.where("hot is not null").select("hot").mapInArrow(_hot_rows, "gram long, classes long")
    found = rows.groupBy("gram").agg(F.sum("classes").alias("classes")).where(F.col("classes") > max(HOT_IN_SLICE, HOT * classes))
    table = found.toArrow()
    grams, often = table.column("gram").to_numpy().view(np.uint64), table.column("classes").to_numpy()
    order = np.argsort(grams)
    return grams[order], often[order]


def sets_with_links(docs: DataFrame, described: DataFrame, rule: Rule) -> DataFrame:
    """``node, n, grams, posted`` of the classes that may have a link, once from each slice that has them."""
    spark = docs.sparkSession
    classes, total = described.agg(F.approx_count_distinct("node"), F.sum("n")).first()
    hot, hot_df = hot_grams(described, classes)
    groups = parallelism(spark)
    parts = min(PARTS, max(groups, -(-(total or 0) // PER_PART)))
    sent = docs.select("text").mapInArrow(_sent(rule, hot, parts), PACKED)
    counted = sent.repartition(groups, "part").sortWithinPartitions("part").mapInArrow(_counted, PACKED)
    gathered = counted.repartition(groups, "slice").sortWithinPartitions("slice")
    return stage(gathered.mapInArrow(_assembled(rule, hot, hot_df), SETS), "sets")


def report(docs: DataFrame, rule: Rule = Rule(words=5)) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stage(texts.mapInArrow(_described(rule), ROWS), "described")
    sets = sets_with_links(texts, described, rule)
    buckets = sets.select("node", "n", F.inline("posted")).dropDuplicates(["key", "node"])

    def members(nodes: DataFrame) -> DataFrame:
        return sets.drop("posted").join(nodes, "node", "left_semi").dropDuplicates(["node"])

    roots = linked_roots(buckets, members, SetComparer(rule))
    return named(described.select("doc_id", "n", "node"), roots).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
