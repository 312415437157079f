import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import frame, prose

from anchorline.llm import search as op

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").encode().translate(LOW))


def brute(rows, items, limit=20):
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in rows]
    bags = [(doc_id, bag) for doc_id, bag in bags if bag]
    n_docs, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, bag in bags:
            m = 100 - 25 + 25 * sum(bag.values()) * n_docs // total
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        ranked = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:limit]
        out += [(item_id, i + 1, doc_id, -score) for i, (score, _, doc_id) in enumerate(ranked)]
    return Counter(out)


def result(docs, items, **more):
    return Counter(tuple(r) for r in op.report(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect())


def benchmark(spark, items):
    rows = [(i, t, "x", 1) for i, t in items]
    return spark.createDataFrame(rows, "item_id long, text string, score string, rank int")


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(4)
    texts = [t for _, t in rows if t]
    found = [(i, " ".join(rng.sample(terms(rng.choice(texts))[:40] or [b"none"], 1)[0].decode() for _ in range(9))) for i in range(30)]
    found += [(50, texts[3]), (51, ""), (52, None), (53, "zzz unheard"), (54, "AN an An " * 50), (54, "ber"), (None, "co co la"), (50, texts[3])]
    return found


def test_against_brute_force(spark, docs, rows, items):
    known = [(i, t) for i, t in items if t is not None]
    assert result(docs, benchmark(spark, items)) == brute(rows, known)


def test_small_tiles_and_blocks_change_nothing(spark, docs, rows, items, monkeypatch):
    for name, value in {"ITEMS": 3, "TERMS": 5, "DOCS": 7, "SALTS": 3}.items():
        monkeypatch.setattr(op, name, value)
    known = [(i, t) for i, t in items if t is not None]
    assert result(docs, benchmark(spark, items), block_bytes=400, limit=5) == brute(rows, known, 5)


def test_ties_go_by_id(spark):
    rows = [(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words here")] * 2 + [(90, "other text")]
    found = op.report(frame(spark, rows), benchmark(spark, [(1, "same")])).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank)] == list(range(1, 21))


def test_empty_tables(spark, no_docs, docs):
    one = benchmark(spark, [(1, "an")])
    assert op.report(no_docs, one).collect() == []
    assert op.report(docs, one.limit(0)).collect() == []


def test_tiles_stay_exact_for_huge_weights():
    """Weights whose plain float64 product would be rounded."""
    rng = np.random.default_rng(2)
    items, terms_ = 4, 60
    row, column = np.divmod(np.arange(items * terms_), terms_)
    weight = rng.integers(1, 1 << 34, items * terms_)
    impact = rng.integers(1, op.IMPACT, (terms_, 3))
    total = np.zeros((items, 3), np.int64)
    for tile in op.term_tiles(items, np.arange(terms_), row, column, weight):
        assert tile.dense(items).sum(1).max() * op.IMPACT < op.EXACT
        total += (tile.dense(items) @ impact[tile.terms].astype(float)).astype(np.int64)
    assert (total == weight.reshape(items, terms_) @ impact).all()


def test_impacts_beyond_64_bits_in_between():
    n = np.array([10**12, 5])
    got = op.impacts(np.array([7, 1]), n, 10**9, 10**15)
    assert got.tolist() == [10**9 * t // (1000 * t + 12 * (75 + 25 * x * 10**9 // 10**15)) for t, x in ((7, 10**12), (1, 5))]
