from collections import Counter, defaultdict
from itertools import product
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from anchorline.llm import sharding as op


def test_shards(docs, rows):
    got = op.report(docs).collect()
    sizes = Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == sizes
    slots, shard_of = defaultdict(list), {}
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard  # equal texts together
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_bytes_are_balanced(spark, no_docs):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(3000)] + [(9000 + i, "copy" * 50) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads = Counter()
    for r in op.report(docs).collect():
        loads[r.shard] += r.size
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 40
    assert op.report(no_docs).collect() == []


def test_differencing_beats_or_equals_greedy():
    sizes = [8, 7, 6, 5, 4]
    parts = op.differencing(sizes, 2)
    loads = Counter()
    for part, size in zip(parts, sizes, strict=True):
        loads[part] += size
    assert sorted(loads.values()) == [14, 16]  # the method's own answer; greedy gives 13 and 17


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=7), st.integers(2, 3))
def test_differencing_is_a_partition_near_the_best(sizes, parts):
    found = op.differencing(sizes, parts)
    assert len(found) == len(sizes) and set(found) <= set(range(parts))

    def largest(assignment):
        return max(sum(s for s, p in zip(sizes, assignment, strict=True) if p == part) for part in range(parts))

    best = min(largest(a) for a in product(range(parts), repeat=len(sizes)))
    assert largest(found) <= best * (4 / 3) + 1e-9
