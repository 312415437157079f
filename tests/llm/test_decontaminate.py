import re
import string
from collections import Counter
from hashlib import sha256

import pytest

from anchorline.llm import decontaminate as op

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items):
    windows = []
    for item, text in items:
        if item is None:
            continue
        own = words(text)
        k = min(10, len(own))
        windows += [(str(item), tuple(own[s : s + k])) for s in range(len(own) - k + 1) if k]
    found = []
    for doc_id, text in rows:
        own = words(text)
        hit, hits = set(), set()
        for item, window in windows:
            k = len(window)
            for s in range(len(own) - k + 1):
                if tuple(own[s : s + k]) == window:
                    hit.update(range(s, s + k))
                    hits.add(item)
        digest = sha256(",".join(sorted(hits)).encode()).hexdigest()
        found.append((doc_id, len(own), len(hit), len(hits), digest, bool(hit)))
    return Counter(found)


@pytest.fixture(scope="module")
def items(rows):
    passage = words(rows[42][1])
    own = [
        (1, " ".join(passage[60:95])),
        (2, "Rep, EAT! rep"),
        (10, rows[2][1]),
        (10, rows[4][1]),
        (3, "a"),
        (4, None),
        (5, ""),
        (None, rows[6][1]),
        (6, "日本語 テキスト"),
        (7, "nowhere to be found in any of these documents at all ever"),
    ]
    return [(i, t) for i, t in own]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(*row, "x") for row in items], "item_id long, text string, n_words string")


@pytest.mark.parametrize("block_bytes", [op.BLOCK_BYTES, 400])
def test_hits_against_brute_force(docs, rows, items, benchmark, block_bytes):
    got = op.report(docs, benchmark, block_bytes=block_bytes).collect()
    assert Counter(map(tuple, got)) == brute(rows, items)


@pytest.mark.parametrize("block_bytes", [op.BLOCK_BYTES, 400])
def test_clean_documents_stay_whole(docs, rows, items, benchmark, block_bytes):
    kept = op.clean(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    expected = Counter(k[0] for k, n in brute(rows, items).items() if not k[-1] for _ in range(n))
    assert Counter(r.doc_id for r in kept.collect()) == expected


def test_empty_tables(docs, no_docs, benchmark):
    assert op.report(no_docs, benchmark).collect() == []
    assert not op.report(docs, benchmark.limit(0)).where("contaminated").count()


def test_the_scan_jumps(items):
    """Positions that no window can end at are passed over."""
    tables = op.WindowsOfLength(10, [b" ".join(op.words_of(items[2][1])[:10])])
    assert tables.shift.max() == 8
    assert (tables.shift == 8).mean() > 0.99
