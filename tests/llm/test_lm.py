import math
from collections import Counter

import pytest

from anchorline.llm import lm as op


def brute(rows, min_count=op.MIN_COUNT):
    texts = [(t or "").encode() for _, t in rows]
    counts = [Counter(raw[i : i + n] for raw in texts for i in range(len(raw) - n + 1)) for n in range(1, 4)]
    total = sum(counts[0].values())

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[0][gram] / total)
        seen = counts[len(gram) - 1][gram]
        if seen >= min_count:
            return math.log(seen / counts[len(gram) - 2][gram[:-1]])
        return math.log(op.BACKOFF) + score(gram[1:])

    sums, sizes = Counter(), Counter()
    for (doc_id, _), raw in zip(rows, texts, strict=True):
        sums[doc_id] += sum(score(raw[max(0, i - 2) : i + 1]) for i in range(len(raw)))
        sizes[doc_id] += len(raw)
    return {i: (sizes[i], sums[i]) for i in sizes}


@pytest.mark.parametrize("min_count", [1, 2, 5])
def test_against_brute_force(docs, rows, min_count):
    expected = brute(rows, min_count)
    got = op.report(docs, min_count).collect()
    assert {r.doc_id for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        size, total = expected[r.doc_id]
        assert r.n_bytes == size
        if size:
            assert r.log_score == pytest.approx(total, abs=2e-3)
            assert r.mean_log_score == pytest.approx(total / size, abs=2e-6)
        else:
            assert r.log_score is None and r.mean_log_score is None


def test_an_empty_table(no_docs):
    assert op.report(no_docs).collect() == []


def test_grams_are_joined_by_hash(plain_docs):
    plan = op.report(plain_docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [gram" in plan
    assert "hashpartitioning(gram" in plan
