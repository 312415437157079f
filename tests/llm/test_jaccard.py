import random
from collections import Counter

import numpy as np
import pytest
from conftest import changed, frame, prose
from test_neardup import shingles

from anchorline.llm import jaccard as op
from anchorline.llm import linking
from anchorline.llm.neardup import Rule


def brute(rows, n=5, percent=80):
    """Per row: id, set size, smallest id of all rows reachable by links."""
    sets = [shingles(text, n) for _, text in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), least.get(find(i))) for i, (doc_id, _) in enumerate(rows))


def result(docs, rule=Rule(words=5)):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in op.report(docs, rule).collect())


@pytest.fixture(scope="module")
def groups():
    """A chain, a cloud at the edge of the threshold, passages that many share, copies."""
    rng = random.Random(8)
    texts, base = [], prose(rng, 120)
    for _ in range(60):
        base = changed(rng, base, 0.01) if rng.random() < 0.7 else " ".join(base.split(" ")[2:] + [prose(rng, 2)])
        texts.append(base)
    other, passage = prose(rng, 150), prose(rng, 60)
    texts += [changed(rng, other, rng.choice([0.0, 0.01, 0.02, 0.03])) for _ in range(60)]
    texts += [" ".join([prose(rng, rng.randint(1, 30)), passage, prose(rng, rng.randint(1, 8))]) for _ in range(40)]
    texts += [texts[0]] * 5 + [texts[70].upper()] * 3
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_awkward_rows(docs, rows):
    assert result(docs) == brute(rows)


@pytest.mark.parametrize("words, percent", [(1, 60), (2, 80), (5, 80), (5, 95)])
def test_against_brute_force(spark, groups, words, percent):
    expected = brute(groups, words, percent)
    assert 1 < len({c for _, _, c in expected}) < len(groups)
    assert result(frame(spark, groups), Rule(words, percent)) == expected


def test_missing_and_repeated_ids_chain_nothing(spark):
    rng = random.Random(2)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(5, a), (None, a + " x"), (9, b), (None, b + " y"), (7, a), (7, b), (None, c), (None, c + " z")]
    assert result(frame(spark, rows)) == brute(rows)


def test_hot_n_grams_small_blocks_and_more_rounds(spark, groups, monkeypatch):
    for name, value in {"HOT": 0.05, "HOT_IN_SLICE": 2, "SLICE": 6000, "PER_PART": 500}.items():
        monkeypatch.setattr(op, name, value)
    hot = []
    whole = op.hot_grams
    monkeypatch.setattr(op, "hot_grams", lambda *args: hot.append(whole(*args)) or hot[-1])
    assert result(frame(spark, groups)) == brute(groups)
    assert len(hot[0][0]) > 20 and (np.diff(hot[0][0].astype(object)) > 0).all()
    for name, value in {"PAIRS_PER_NODE": 0, "GAIN": 0.99, "MARKS": 4}.items():
        monkeypatch.setattr(linking, name, value)
    assert result(frame(spark, groups)) == brute(groups)


@pytest.mark.parametrize("block", [1, 7])
def test_small_blocks(spark, groups, block, monkeypatch):
    whole = op.linked_roots
    monkeypatch.setattr(op, "linked_roots", lambda *args: whole(*args, block=block))
    monkeypatch.setattr(linking, "PAIRS_PER_NODE", 10**9)
    assert result(frame(spark, groups)) == brute(groups)


def test_filters_keep_every_linked_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(1 << 62, size=100, dtype=np.uint64)
    rows = [np.sort(np.concatenate([base[rng.random(100) < p], rng.integers(1 << 62, size=k, dtype=np.uint64)])) for p in (1, 0.95, 0.9, 0.8) for k in (0, 5, 15)]
    import pyarrow as pa

    loaded = op.Sets(Rule(), pa.table({"n": [len(r) + 1 for r in rows], "grams": [r.tobytes() for r in rows]}))
    x, y = np.triu_indices(len(rows), 1)
    kept = set(zip(*(c.tolist() for c in loaded.possible(x, y)), strict=True))
    linked = {p for p in zip(x.tolist(), y.tolist(), strict=True) if loaded.linked(*p)}
    assert linked and linked <= kept and len(kept) < len(x)


def test_an_empty_table(no_docs):
    assert op.report(no_docs).collect() == []
