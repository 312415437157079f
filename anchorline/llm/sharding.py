"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form a group that may not be divided.  Groups are
summed by a digest of their text; those holding at least ``1/heavy`` of all
bytes are items of their own (so there are at most ``heavy``), all others are
dealt by their digest to ``bundles`` items.  The differencing runs over these
items, whose number does not depend on the input: it keeps partial partitions
in a heap and repeatedly joins the two with the largest spread, the largest
part of one with the smallest of the other.

Slots number the rows of a shard without gaps: rows are numbered within
(shard, salt) and shifted by the rows of the salts before, so no window holds a
shard.

Defined results: a NULL text has no bytes and groups with the empty text;
repeated rows keep a slot each; a NULL doc_id is a value like any other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARDS = 16
BUNDLES = 8192
HEAVY = 1024
SALTS = 1024


def differencing(sizes: list[int], parts: int) -> list[int]:
    """The part of each item, by the largest differencing method."""
    if not sizes:
        return []
    heap = []
    for number, size in enumerate(sizes):
        load = [0] * (parts - 1) + [size]
        heap.append((-size, number, load, [[] for _ in range(parts - 1)] + [[number]]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, load, items = heapq.heappop(heap)
        _, _, other_load, other_items = heapq.heappop(heap)
        joined = sorted(
            (
                (load[i] + other_load[parts - 1 - i], i, items[i], other_items[parts - 1 - i])
                for i in range(parts)
            ),
            key=lambda part: part[:2],
        )
        low = joined[0][0]
        merged = []
        for _, _, mine, yours in joined:  # the shorter list moves
            mine, yours = (mine, yours) if len(mine) >= len(yours) else (yours, mine)
            mine.extend(yours)
            merged.append(mine)
        heapq.heappush(heap, (low - joined[-1][0], tie, [part[0] - low for part in joined], merged))
    part_of = [0] * len(sizes)
    for part, members in enumerate(heap[0][3]):
        for number in members:
            part_of[number] = part
    return part_of


def shards(docs: DataFrame, count: int = SHARDS, bundles: int = BUNDLES, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    # texts are read once; from here on a row is about a hundred bytes
    rows = stage(rows.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")), "shard-rows")
    groups = rows.groupBy("digest", "bundle").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("bytes") * heavy >= F.lit(total)
    # at most `heavy` and `bundles` rows come to the driver
    alone = [(row.digest, row.bytes) for row in groups.where(large).collect()]
    shared = [tuple(row) for row in groups.where(~large).groupBy("bundle").agg(F.sum("bytes")).collect()]
    alone.sort()
    shared.sort()
    part_of = differencing([size for _, size in alone + shared], count)
    spark = docs.sparkSession
    shard_of = np.zeros(bundles, int)
    shard_of[[b for b, _ in shared]] = part_of[len(alone) :]
    small = spark.createDataFrame(list(enumerate(shard_of.tolist())), "bundle int, bundle_shard int")
    own = spark.createDataFrame(
        [(digest, part) for (digest, _), part in zip(alone, part_of, strict=False)], "digest string, own_shard int"
    )
    placed = (
        rows.join(F.broadcast(small), "bundle")
        .join(F.broadcast(own), "digest", "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce("own_shard", "bundle_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    return numbered(placed, "shard", "salt", ["doc_id", "text_crc32"], "slot")


def numbered(rows: DataFrame, key: str, salt: str, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 within ``key``, counted in bounded pieces.

    ``salt`` spreads a key's rows over pieces.  Keys and salts have fixed ranges
    here, so the (key, salt) counts that are summed and broadcast are few
    however many rows there are.
    """
    before = (
        rows.groupBy(key, salt)
        .count()
        .withColumn(
            "_before",
            F.sum("count").over(Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(F.col(key).alias("_key"), F.col(salt).alias("_salt"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    at = F.row_number().over(Window.partitionBy(key, salt).orderBy(*order))
    local = rows.withColumn("_at", at - 1)
    return (
        local.join(F.broadcast(before), (F.col(key) == F.col("_key")) & (F.col(salt) == F.col("_salt")))
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_key", "_salt", "_before", "_at", salt)
    )


def report(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """The shards by bytes: balanced by size, equal texts together."""
    return shards(docs, count).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
