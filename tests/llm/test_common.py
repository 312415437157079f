import numpy as np
import pyarrow as pa

from anchorline.llm import common as op


def test_powers_beyond_those_kept():
    n = op.KEPT_POWERS + 5
    long = op.powers(n, op._BASE)
    assert len(long) == n and long[0] == 1
    assert np.array_equal(long[1:], long[:-1] * np.uint64(op._BASE))
    assert np.array_equal(op.powers(1000, op._BASE), long[:1000])
    assert len(op.powers(0, op._BASE)) == 0


def test_spans_of_long_token_arrays_equal_those_alone():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 256, op.KEPT_POWERS + 1000)
    starts = np.array([0, 7, op.KEPT_POWERS - 3, op.KEPT_POWERS + 600])
    found = op.Prefix(tokens).spans(starts, starts + 300)
    for at, hashed in zip(starts.tolist(), found.tolist(), strict=True):
        alone = op.Prefix(tokens[at : at + 300]).spans(np.array([0]), np.array([300]))
        assert alone.tolist() == [hashed]


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.num_rows], "size": [batch.nbytes]})

    got = op.keyed_text(docs).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000
    assert max(r.size for r in got) < 1.1 * op.BATCH_BYTES


def test_a_worker_gives_unused_memory_back_after_its_task(monkeypatch):
    calls = []
    monkeypatch.setattr(op, "_trim", lambda: calls.append)
    batch = pa.record_batch({"text": ["a", None, "b"]})
    assert [len(part) for part in op.slices(iter([batch, batch]))] == [3, 3]
    assert calls == [0]
    monkeypatch.setattr(op, "_trim", lambda: None)  # a C library without it
    assert [len(part) for part in op.slices(iter([batch]))] == [3]
