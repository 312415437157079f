import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from conftest import frame

from anchorline.llm import substrings as op
from anchorline.llm import superkmers
from anchorline.llm.common import NO_ID


def brute(rows, window=50):
    firsts = {}
    split = [(NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for doc_id, words in split:
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            firsts[own] = min(firsts.get(own, doc_id), doc_id)
    found = []
    for (doc_id, _), (key, words) in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(words) - window + 1):
            if firsts[tuple(words[s : s + window])] < key:
                gone.update(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        found.append((doc_id, len(words), len(gone), sha256(kept).hexdigest()))
    return Counter(found)


def test_against_brute_force(docs, rows):
    assert Counter(map(tuple, op.report(docs).collect())) == brute(rows)


def test_an_empty_table(no_docs):
    assert op.report(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, seed):
    rng = random.Random(seed)
    few = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    scheme = superkmers.Scheme(window=9, k=3, words=True)
    assert Counter(map(tuple, op.report(frame(spark, few), scheme).collect())) == brute(few, 9)


def test_windows_of_a_passage_that_all_share_stay_apart_from_their_texts(spark):
    """Frequent k-mers are not chosen where a text has others, so one bucket gathers one string."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(70))
    own = lambda: " ".join(f"w{rng.random()}" for _ in range(60))
    many = [(i, f"{own()} {passage} {own()}") for i in range(300)]
    found = superkmers.repeats(frame(spark, many), op.WORDS)
    buckets = found.strings.groupBy("minimiser").count().collect()
    assert max(row["count"] for row in buckets) <= 3
    assert found.strings.count() < 20
    runs = found.runs.groupBy("content").count().collect()
    assert max(row["count"] for row in runs) > 270  # some texts have a k-mer in a crowded slot


def test_runs_cover_every_window_once():
    from anchorline.llm.common import Slice

    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    part = Slice(pa.record_batch({"x": list(range(50))}), 0, 50, offsets, data)
    scheme = superkmers.Scheme(window=7, k=3, words=True)
    owner, first, count, minimiser, content = superkmers.super_kmers(part, scheme, np.zeros(1 << 16, bool))
    covered = Counter((o, s + i) for o, s, n in zip(owner, first, count, strict=True) for i in range(n))
    assert set(covered.values()) <= {1}
    assert len(covered) == sum(max(0, len(t.split()) - 6) for t in texts)
    window_of = {}
    for o, s, n, m in zip(owner, first, count, minimiser, strict=True):
        words = texts[o].split()
        for i in range(n):
            assert window_of.setdefault(tuple(words[s + i : s + i + 7]), m) == m
