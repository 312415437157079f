"""Buckets of candidates that no task may hold whole."""

import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import changed, frame, prose
from test_neardup import brute

from anchorline.llm import linking as op
from anchorline.llm import neardup


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_meet_in_every_open_pair_once_and_stay_small(spark, block):
    sizes = {1: [9, 4, 1], 2: [1] * 12, 3: [2, 1]}
    rows, roots = [], {}
    for key, counts in sizes.items():
        node = 100 * key
        for root, n in enumerate(counts):
            for _ in range(n):
                rows.append((key, node, 1000 * key + root, 1000 * key, sum(counts), counts[0]))
                roots[node] = 1000 * key + root
                node += 1
    members = spark.createDataFrame(rows, "key long, node long, root long, main long, members long, most long")
    cells = {}
    for r in op.in_blocks(members, block).collect():
        cells.setdefault((r.key, r.low, r.high), []).append(r)
    met = Counter()
    for (key, low, high), own in cells.items():
        for x, y in combinations(own, 2):
            if (low == high or x.block != y.block) and x.root != y.root:
                met[tuple(sorted((x.node, y.node)))] += 1
    wanted = {(a, b) for a, b in combinations(sorted(roots), 2) if a // 100 == b // 100 and roots[a] != roots[b]}
    assert set(met) == wanted and set(met.values()) == {1}
    if block == 3:  # before, the bucket of 14 was one group
        assert max(map(len, cells.values())) < 12


def test_small_blocks_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 120)
    rows = [(i, changed(rng, base, 0.004 * i)) for i in range(30)]
    whole, cells = op.in_blocks, []

    def in_small_blocks(members, block):
        found = whole(members, 2)
        cells.append(found.select("key", "low", "high").distinct().count())
        return found

    monkeypatch.setattr(op, "in_blocks", in_small_blocks)
    monkeypatch.setattr(op, "PAIRS_PER_NODE", 10**9)
    got = {r.doc_id: r.component_id for r in neardup.report(frame(spark, rows), neardup.Rule(words=2)).collect()}
    assert got == {i: c for i, _, c in brute(rows, 2)}
    assert cells and cells[0] > 0
