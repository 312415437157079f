"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct shingles of ``words`` words.  Documents whose
sets have a Jaccard index of at least ``percent`` are linked, and linked
documents form components.

1. Documents with equal sets are one *class*, whatever their ids; a hash of the set
   names it.
2. A class has ``BANDS`` band keys of ``ROWS`` min-hashes each.  Classes that
   share a key are candidates; at the threshold of 80 % a pair shares none with
   a probability of 3e-8.
3. Candidates are joined by ``linking``.  Those whose set sizes exclude a link are
   left out; the others are compared by batches of their signatures: with a uniform
   prior the posterior of the Jaccard index is a beta distribution, and a pair
   is pruned as soon as it is at the threshold or above with a probability
   below ``MISS``.
4. Survivors are verified on their full sets, inside the same task.

A bucket of candidates is never expanded into all its pairs, and what leaves a task are
links, at most one for each component that came in (see ``linking``).  The comparisons
of the last step still grow with the members of a region outside its largest component
times all its members; they are spread over tasks by blocks.

Defined results: a NULL, empty or blank text has no shingles and is a component
of its own; a text of fewer words than a shingle has one, all its words; each row is a
document, and rows of one id are not linked by it; a component is named by its smallest
id, a component without any id has none; repeated rows get equal results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    LOWER,
    NOT_SPACE,
    Prefix,
    Slice,
    keyed_text,
    record_batch,
    slices,
    stage,
    word_hashes,
    word_spans,
)
from .linking import linked_roots, named

ROWS, BANDS = 5, 44
#: min-hashes of a signature, compared in batches
SIGNATURE, BATCH = 96, 16
MISS = 1e-8

@dataclass(frozen=True)
class Rule:
    """Shingle length and the least Jaccard index in percent."""

    words: int = 5
    percent: int = 80

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def shingle_sets(part: Slice, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data = LOWER[part.data]
    starts, ends, bounds = word_spans(data, part.offsets, NOT_SPACE)
    prefix = Prefix(word_hashes(data, starts, ends))
    hashes = prefix.windows(words)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(hashes[a : b - words + 1])
        elif b > a:
            yield prefix.spans(np.array([a]), np.array([b]))
        else:
            yield hashes[:0]


def node_of(shingles: np.ndarray) -> int:
    """The name of the class of one set."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


class MinHashes:
    """``ROWS * BANDS`` min-hashes of a shingle set."""

    def __init__(self, count: int = ROWS * BANDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1 << 32, size=count, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(1 << 32, size=count, dtype=np.uint32)

    def __call__(self, shingles: np.ndarray, at_once: int = 512) -> np.ndarray:
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), at_once):
            h = short[at : at + at_once, None] * self.factor
            h += self.shift
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            np.minimum(least, h.min(0), out=least)
        return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key per band; bands differ by their number."""
    table = np.column_stack([np.arange(BANDS, dtype=np.uint32), least.reshape(BANDS, ROWS)])
    width = ROWS + 1
    starts = np.arange(BANDS) * width
    return Prefix(table.ravel()).spans(starts, starts + width).view(np.int64)


ROWS_OF = "doc_id long, id_key long, text_key long, n long, node long, bands array<long>, signature binary"
_ROWS_OF = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("id_key", pa.int64()),
        ("text_key", pa.int64()),
        ("n", pa.int64()),
        ("node", pa.int64()),
        ("bands", pa.list_(pa.int64())),
        ("signature", pa.binary()),
    ]
)


def _sketch(rule: Rule):
    """Every row's set size and class; bands and signature at a class's first row in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhashes = MinHashes()
        for part in slices(batches):
            seen: set[int] = set()
            rows = []
            for shingles in shingle_sets(part, rule.words):
                node = node_of(shingles) if len(shingles) else None
                if node is None or node in seen:
                    rows.append((len(shingles), node, None, None))
                    continue
                seen.add(node)
                least = minhashes(shingles)
                rows.append((len(shingles), node, band_keys(least), least[:SIGNATURE].astype(np.uint16).tobytes()))
            keys = [part.column(c) for c in ("doc_id", "id_key", "text_key")]
            yield record_batch(_ROWS_OF, *keys, *(list(c) for c in zip(*rows, strict=True)))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are sent and kept."""
    schema = pa.schema([("id_key", pa.int64()), ("text_key", pa.int64()), ("packed", pa.binary())])
    press = zstandard.ZstdCompressor(level=1)
    for part in slices(batches):
        packed = [press.compress(text) for text in part.texts()]
        yield record_batch(schema, part.column("id_key"), part.column("text_key"), packed)


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """By batches compared: the matches below which a pair is pruned.

    After m matches of n the posterior is Beta(m + 1, n - m + 1), whose upper tail
    at t is the lower tail of Binomial(n + 1, t) at m.
    """
    t = percent / 100
    bounds = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        bounds.append(m)
    return bounds


class Signed:
    """Signatures and, on demand, the full sets of some classes inside a task."""

    def __init__(self, rule: Rule, table: pa.Table):
        self.rule, self.bounds = rule, least_matches(rule.percent)
        self.n = table.column("n").to_numpy()
        self.signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, SIGNATURE)
        self.packed = table.column("packed")
        self.sets: dict[int, np.ndarray] = {}

    def possible(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alive = 100 * np.minimum(self.n[x], self.n[y]) >= self.rule.percent * np.maximum(self.n[x], self.n[y])
        x, y = x[alive], y[alive]
        matches = np.zeros(len(x), np.int64)
        for turn, bound in enumerate(self.bounds):
            columns = slice(turn * BATCH, (turn + 1) * BATCH)
            matches += (self.signatures[x, columns] == self.signatures[y, columns]).sum(1)
            alive = matches >= bound
            x, y, matches = x[alive], y[alive], matches[alive]
        return x, y

    def prepare(self, rows: np.ndarray) -> None:
        fresh = [i for i in rows.tolist() if i not in self.sets]
        press = zstandard.ZstdDecompressor()
        texts = pa.array([press.decompress(self.packed[i].as_py()) for i in fresh], pa.large_binary())
        parts = slices([pa.RecordBatch.from_arrays([texts], ["text"])])
        self.sets.update(zip(fresh, (s for part in parts for s in shingle_sets(part, self.rule.words)), strict=True))

    def linked(self, x: int, y: int) -> bool:
        return self.rule.linked(self.sets[x], self.sets[y])


@dataclass(frozen=True)
class SignatureComparer:
    rule: Rule

    columns = ["n", "signature", "packed"]

    def load(self, table: pa.Table) -> Signed:
        return Signed(self.rule, table)

    def formed(self, a: str, b: str) -> Column:
        return F.lit(True)


def sketch(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``doc_id, id_key, text_key, n, node`` of every row, and ``node, root`` of the classes with a link."""
    texts = keyed_text(docs)
    keyed = texts.select("id_key", "text_key", "text")
    rows = stage(texts.mapInArrow(_sketch(rule), ROWS_OF), "rows")
    classes = rows.where("bands is not null").groupBy("node").agg(
        F.min(F.struct("id_key", "text_key")).alias("row"),
        *[F.first(c).alias(c) for c in ("n", "bands", "signature")],
    )
    classes = stage(classes, "classes")

    def members(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, "node", "left_semi").select("row.*", "node", "n", "signature")
        packed = keyed.mapInArrow(_packed, "id_key long, text_key long, packed binary")
        found = packed.join(wanted, ["id_key", "text_key"]).groupBy("node")  # repeated rows come several times
        return found.agg(*[F.first(c).alias(c) for c in SignatureComparer.columns])

    buckets = classes.select("node", F.explode("bands").alias("key"))
    roots = linked_roots(buckets, members, SignatureComparer(rule))
    return rows.select("doc_id", "id_key", "text_key", "n", "node"), roots


def membership(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, id_key, text_key, n, node, root, component_id`` of every row."""
    rows, roots = sketch(docs, rule)
    return named(rows, roots)


def report(docs: DataFrame, rule: Rule = Rule(words=2)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    return membership(docs, rule).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def decisions(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``id_key, text_key, copies, kept``: which rows stay, one of each component, and how often each row comes.

    The first by (doc_id, text) stays, rows without an id come last; a row without
    words stays.
    """
    found = membership(docs, rule)
    rows = found.groupBy("id_key", "text_key", "node", "root").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct("id_key", "text_key")
    first = rows.where("root is not null").groupBy("root").agg(F.min(place).alias("first"))
    return rows.join(first, "root", "left").select(
        "id_key", "text_key", F.when(F.col("root").isNull(), 1).otherwise(F.col("copies")).alias("copies"),
        F.coalesce(place == F.col("first"), F.lit(True)).alias("kept"),
    )
