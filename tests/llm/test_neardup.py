import random
import string
from collections import Counter

import numpy as np
import pytest
from conftest import changed, frame, prose

from anchorline.llm import linking
from anchorline.llm import neardup as op

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n):
    words = (text or "").translate(LOW).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def test_missing_and_repeated_ids_chain_nothing(spark):
    """Two rows without an id, and one id on two texts, near copies of different documents."""
    rng = random.Random(2)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(5, a), (None, a + " x"), (9, b), (None, b + " y"), (7, a), (7, b)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in op.report(frame(spark, rows)).collect())
    assert got == Counter([(5, 5, True), (None, 5, False), (9, 7, False), (None, 7, False), (7, 5, False), (7, 7, True)])


def brute(rows, n=2, percent=80):
    """Per row: id, set size, smallest id reachable."""
    sets = [(doc_id, shingles(text, n)) for doc_id, text in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a_id, a) in enumerate(sets):
        for j, (b_id, b) in enumerate(sets[:i]):
            common = len(a & b)
            linked = a and b and 100 * common >= percent * (len(a) + len(b) - common)
            if linked or (a_id is not None and a_id == b_id):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            first[find(i)] = min(first.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(s), first.get(find(i))) for i, (doc_id, s) in enumerate(sets))


def result(docs, rule):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in op.report(docs, rule).collect())


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(plain_docs, plain, words):
    assert result(plain_docs, op.Rule(words)) == brute(list(plain.items()), words)


def test_repeated_rows_and_missing_ids(docs, rows):
    got = op.report(docs).collect()
    assert len(got) == len(rows)
    by_row = Counter((r.doc_id, r.n_shingles) for r in got)
    assert by_row == Counter((i, len(shingles(t, 2))) for i, t in rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id <= r.doc_id
            assert r.kept == (r.doc_id == r.component_id)
    linked = [r for r in got if r.doc_id is None]
    assert sorted((r.component_id, r.kept) for r in linked if r.component_id is not None) == [(5, False)]
    assert [r.kept for r in linked if r.component_id is None] == [True]


def test_an_empty_table(no_docs):
    assert op.report(no_docs).collect() == []


def test_chains_and_large_groups(spark):
    """Copies at all distances: many links go neither through the first nor through one centre."""
    rng = random.Random(8)
    rows, n = [], 0
    base = prose(rng, 120)
    for _ in range(90):  # a chain: each is near the one before only
        base = changed(rng, base, 0.03) if rng.random() < 0.7 else " ".join(base.split(" ")[2:] + [prose(rng, 2)])
        rows.append((n, base))
        n += 1
    other = prose(rng, 100)
    for _ in range(60):  # a cloud about one text, at the edge of the threshold
        rows.append((n, changed(rng, other, rng.choice([0.0, 0.04, 0.06, 0.08]))))
        n += 1
    rng.shuffle(rows)
    expected = brute(rows)
    assert 1 < len({c for _, _, c in expected}) < 60
    assert result(frame(spark, rows), op.Rule(2)) == expected


def test_rounds_give_what_the_last_comparison_alone_gives(spark, plain_docs, plain, monkeypatch):
    monkeypatch.setattr(linking, "PAIRS_PER_NODE", 0)
    monkeypatch.setattr(linking, "GAIN", 0.99)
    assert result(plain_docs, op.Rule(2)) == brute(list(plain.items()))


def test_pruning_bounds_keep_the_miss_probability():
    rng = np.random.default_rng(1)
    bounds = op.least_matches(80)
    assert bounds == sorted(bounds) and bounds[-1] > 40
    matches = np.cumsum(rng.random((200_000, op.SIGNATURE)) < 0.8, 1)[:, op.BATCH - 1 :: op.BATCH]
    assert (matches >= np.array(bounds)).all()
    low = np.cumsum(rng.random((2000, op.SIGNATURE)) < 0.3, 1)[:, op.BATCH - 1 :: op.BATCH]
    assert not (low >= np.array(bounds)).all(1).any()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(500, 499), (7, 7)]
    random.Random(1).shuffle(edges)
    got = linking.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), [499, 500], list(range(1000, 1040))]
