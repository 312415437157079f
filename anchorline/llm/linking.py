"""Components of linked nodes, from buckets of candidates.

Nodes that share a bucket are candidates, and a comparer says which candidates are
linked.  All links between candidates count, but a bucket is never expanded into its
pairs:

1. Buckets with the same members are one bucket.
2. Each node is compared with one centre of its buckets; links give components.
3. Buckets whose centres are in one component form a *region*, and a node comes once to
   a region, with the list of its buckets there: two nodes are compared once in a
   region, however many buckets they share.  Only candidates of *different* components
   are left to compare; a region that holds one component is closed and never looked at
   again.
4. While regions would need many comparisons, and each round takes a good part of them
   away, all members of a region are compared with one more centre, drawn at random from
   the nodes outside the largest component.
5. At last each region is compared inside tasks: nodes outside the largest component with
   all others that share a bucket.  A region of more than ``BLOCK`` nodes is cut into
   blocks, and every pair of blocks is a group of rows of its own, so no task holds a
   region that grows with the corpus.  A task joins what it finds linked at once and
   returns at most one link per component it got, never a pair that isn't linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_tasks_of, parallelism, record_batch, stage, whole_groups

#: Nodes of a region that are compared with each other, or with as many others, at once.
BLOCK = 1024
#: Another centre is tried while a region's last comparison has more pairs than this a
#: node, and while the round before left less than ``GAIN`` of them.
PAIRS_PER_NODE, GAIN = 512, 0.75
#: Counted links and labels that one task takes.
PER_TASK = 200_000
#: Columns in which a region's buckets are marked; two that share one are compared once more than needed.
MARKS = 512

LINKS = "a long, b long"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Loaded(Protocol):
    """Some nodes inside a task."""

    def possible(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of row numbers that may be linked."""

    def prepare(self, rows: np.ndarray) -> None:
        """Make the rows' full sets ready."""

    def linked(self, x: int, y: int) -> bool:
        """The exact answer."""


class Comparer(Protocol):
    #: columns that it needs of every node
    columns: list[str]

    def load(self, table: pa.Table) -> Loaded: ...

    def formed(self, a: str, b: str) -> Column:
        """Whether a pair that meets in a bucket is worth a comparison, by the columns of the bucket's rows."""


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame, seed: int = 0) -> DataFrame:
    """``node, root``: nodes of one component share a root, which is one of them.

    Each step contracts every node to the first of its neighbours and itself: by
    id in the first step, which collapses stars around their smallest id, then
    in an order drawn anew, which leaves a constant share on average.
    """
    roots = None
    step = seed
    edges = stage(links.where("a <> b").distinct(), "edges")

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stage(in_tasks_of(df, first, PER_TASK), name)

    first = size = edges.count()
    while size:
        both = edges.unionAll(edges.select("b", "a"))
        rank = F.xxhash64(F.col("b"), F.lit(step)) if step else F.col("b")
        own = F.xxhash64(F.col("a"), F.lit(step)) if step else F.col("a")
        best = both.groupBy("a").agg(F.min(rank).alias("rank"), F.min_by("b", rank).alias("b"))
        target = F.when(F.col("rank") < own, F.col("b")).otherwise(F.col("a"))
        to = kept(best.select(F.col("a").alias("node"), target.alias("to")), "contracted")
        if roots is None:
            roots = to.withColumnRenamed("to", "root")
        else:
            step_to = to.toDF("root", "to")
            roots = roots.join(step_to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        a, b = to.toDF("a", "to_a"), to.toDF("b", "to_b")
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        edges = kept(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        size = edges.count()
        step += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return kept(roots, "roots")  # the steps' small maps joined one after the other


def _composed(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots``, whose roots ``more`` has joined further."""
    moved = roots.join(more.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(moved.unionAll(more.join(roots.select("node"), "node", "left_anti")), "roots")


def distinct_buckets(buckets: DataFrame) -> DataFrame:
    """The buckets of several nodes, one for each set of nodes, with their first node as centre.

    The centre's columns have ``_c`` at their end.
    """
    content = [F.bit_xor(F.xxhash64("node", F.lit(n))).alias(f"mark_{n}") for n in (1, 2)]
    centre = F.min_by(F.struct(*[F.col(c).alias(f"{c}_c") for c in buckets.columns if c != "key"]), "node")
    each = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), *content, centre.alias("c")).where("nodes > 1")
    kept = each.groupBy("nodes", "mark_1", "mark_2").agg(F.min_by(F.struct("key", "c.*"), "key").alias("one")).select("one.*")
    return stage(buckets.join(kept, "key"), "buckets")


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members`` once for every pair of blocks, ``low`` and ``high``, that they are compared in.

    A group of at most ``block`` members is one block.  In others the members outside
    the largest component fill the first blocks, which meet each other and all others;
    those of the largest component fill the rest, which meet the first ones only.
    """
    small = F.col("members") <= block
    minor = F.ceil((F.col("members") - F.col("most")) / block)
    major = F.ceil(F.col("most") / block)
    inside = F.col("root") == F.col("main")
    draw = F.xxhash64("node", F.lit("block"))
    own = F.when(small, F.lit(0)).when(inside, minor + F.pmod(draw, major)).otherwise(F.pmod(draw, minor))
    others = F.when(small, F.lit(1)).when(inside, minor).otherwise(minor + major)
    met = F.explode(F.sequence(F.lit(0).cast("long"), others.cast("long") - 1))
    placed = members.withColumn("block", own.cast("long")).withColumn("met", met)
    low, high = F.least("block", "met"), F.greatest("block", "met")
    return placed.withColumns({"low": low, "high": high}).withColumn("cell", F.xxhash64("key", "low", "high"))


def joined_roots(
    loaded: Loaded,
    nodes: np.ndarray,
    roots: np.ndarray,
    main: int,
    marks: np.ndarray,
    blocks: np.ndarray | None = None,
    pairs_at_once: int = 1 << 20,
) -> list[tuple[int, int]]:
    """Links that join the roots of one group of nodes as all its links would.

    Compared are nodes of different roots, at least one of them not ``main``, that
    have a mark in common; with ``blocks`` only those of different blocks.
    """
    names, code = np.unique(roots, return_inverse=True)
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    minor = np.flatnonzero(roots != main)
    step = max(1, pairs_at_once // max(1, len(nodes)))
    for at in range(0, len(minor), step):
        some = minor[at : at + step]
        open_pairs = (roots[some, None] != roots[None]) & ((roots[None] == main) | (nodes[some, None] < nodes[None]))
        if blocks is not None:
            open_pairs &= blocks[some, None] != blocks[None]
        open_pairs &= (marks[some] @ marks.T) > 0
        x, y = np.nonzero(open_pairs)
        x, y = loaded.possible(some[x], y)
        if not len(x):
            continue
        loaded.prepare(np.unique(np.concatenate([x, y])))
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(code[i]), find(code[j])
            if a != b and loaded.linked(i, j):
                parent[max(a, b)] = min(a, b)
    return [(int(names[find(i)]), int(names[i])) for i in range(len(names)) if find(i) != i]


def _in_regions(comparer: Comparer):
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = np.stack([table.column(c).to_numpy() for c in ("key", "low", "high")])
        nodes, roots, main, blocks = (table.column(c).to_numpy() for c in ("node", "root", "main", "block"))
        edges = np.flatnonzero((np.diff(cells) != 0).any(0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(nodes)], strict=True):
            own = slice(a, b)
            keys = table.column("keys").slice(a, b - a).combine_chunks()
            held = np.diff(keys.offsets.to_numpy())
            marks = np.zeros((b - a, MARKS), np.float32)
            marks[np.repeat(np.arange(b - a), held), keys.flatten().to_numpy() % MARKS] = 1
            across = blocks[own] if cells[1, a] != cells[2, a] else None
            loaded = comparer.load(table.slice(a, b - a))
            found = joined_roots(loaded, nodes[own], roots[own], main[a], marks, across)
            if found:
                yield record_batch(_LINKS, *(list(c) for c in zip(*found, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            yield from work(table)

    return run


def _in_pairs(comparer: Comparer, at_once: int = 512):
    columns = comparer.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                n = batch.num_rows
                sides = [pa.table([batch.column(f"{c}_{s}") for c in columns], names=columns) for s in "xy"]
                loaded = comparer.load(pa.concat_tables(sides).combine_chunks())
                x, y = loaded.possible(np.arange(n), np.arange(n, 2 * n))
                loaded.prepare(np.concatenate([x, y]))
                alive = [i for i, j in zip(x.tolist(), y.tolist(), strict=True) if loaded.linked(i, j)]
                yield record_batch(_LINKS, *(batch.column(c).take(pa.array(alive, pa.int64())) for c in "ab"))

    return run


def tested(pairs: DataFrame, members: DataFrame, comparer: Comparer) -> DataFrame:
    """The labels ``a, b`` of those of the pairs ``x, y, a, b`` that are linked."""
    x, y = (members.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in comparer.columns]) for s in "xy")
    fetched = pairs.join(x, "x").join(y, "y").select("a", "b", *[f"{c}_{s}" for c in comparer.columns for s in "xy"])
    return stage(fetched.mapInArrow(_in_pairs(comparer), LINKS), "links")


def _regions(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, node, keys``: every region's nodes with their buckets there."""
    of_centre = rest.select("key", "node", "node_c").join(roots.toDF("node_c", "region"), "node_c", "left")
    region = F.coalesce("region", "node_c").alias("region")
    listed = of_centre.groupBy(region, "node").agg(F.collect_list("key").alias("keys"))
    return listed.withColumnRenamed("region", "key")


def _merged(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """The regions, those whose centres' components have been joined as one."""
    moved = regions.select("key", "node", "keys").join(roots.toDF("key", "to"), "key", "left")
    joined = F.flatten(F.collect_list("keys")).alias("keys")
    return moved.groupBy(F.coalesce("to", "key").alias("region"), "node").agg(joined).withColumnRenamed("region", "key")


def _opened(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """The regions of several components: ``key, node, keys, root, main, members, most``.

    ``main`` is the largest component of ``most`` of the region's ``members``.
    """
    labelled = regions.select("key", "node", "keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = F.max_by("root", F.struct("n", "root")).alias("main")
    sizes = by_root.groupBy("key").agg(main, F.sum("n").alias("members"), F.max("n").alias("most"), F.count(F.lit(1)).alias("roots"))
    return stage(labelled.join(sizes.where("roots > 1").drop("roots"), "key"), "regions")


def linked_roots(
    buckets: DataFrame, members: Callable[[DataFrame], DataFrame], comparer: Comparer, block: int = BLOCK
) -> DataFrame:
    """``node, root`` of all nodes that have a link; nodes of one component share a root.

    ``buckets`` has ``key, node`` and what ``comparer.formed`` reads; ``members`` gives
    the given nodes with the comparer's columns.
    """
    rest = distinct_buckets(buckets)
    held = stage(members(rest.select("node").distinct()), "members")
    met = rest.where(F.col("node") != F.col("node_c")).where(comparer.formed("", "_c"))
    nearest = met.groupBy("node").agg(F.min("node_c").alias("node_c"))
    pairs = nearest.select(F.col("node").alias("x"), F.col("node_c").alias("y"), *_ordered("node", "node_c"))
    roots = components(tested(pairs, held, comparer))
    regions, before = _regions(rest, roots), None
    while True:
        regions = _opened(regions, roots)
        each = (F.col("members") - F.col("most")).cast("double")  # pairs of one node
        cost, nodes = regions.agg(F.sum(each), F.count(F.lit(1))).first()
        if not nodes:
            return roots
        if cost <= PAIRS_PER_NODE * nodes or (before and cost > GAIN * before):
            break
        before = cost
        minor = regions.where("root <> main")
        centre = F.min_by(F.struct("node", "root", "keys"), F.xxhash64("node", F.lit(cost)))
        drawn = minor.groupBy("key").agg(centre.alias("c"))
        shared = (F.col("root") != F.col("c.root")) & F.arrays_overlap("keys", "c.keys")
        met = regions.join(drawn, "key").where(shared)
        pairs = met.select(F.col("node").alias("x"), F.col("c.node").alias("y"), *_ordered("root", "c.root")).distinct()
        roots = _composed(roots, components(tested(pairs, held, comparer)))
        regions = _merged(regions, roots)
    cells = in_blocks(regions, block)
    cells = cells.select("cell", "key", "low", "high", "block", "node", "root", "main", "keys")
    dealt = cells.join(held, "node").repartition(parallelism(cells.sparkSession), "cell")
    found = dealt.sortWithinPartitions("cell", "key", "low", "high", "node").mapInArrow(_in_regions(comparer), LINKS)
    return _composed(roots, components(found))


def named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root`` and ``component_id``, the smallest id of all rows of one root.

    Rows of a node without a root are a component of their own; a row without a node is
    one alone.
    """
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = own.groupBy("root").agg(F.min("least").alias("component"))
    found = own.join(firsts, "root").select("node", "root", "component")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.join(found, "node", "left").withColumn("component_id", alone).drop("component")
