import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from conftest import frame, prose

from anchorline.llm import runs as op

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(doc_id, text, edited):
    words = WORD.findall((text or "").encode())
    n = len(words)
    if edited and doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def runs_of(words, least=6, exponent=4):
    """Every stretch by trying every period in ascending order."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                inner = [r for r in found if q % r[2] == 0 and r[0] <= i and r[0] + r[1] >= i + length]
                if not inner:
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(rows, edited=True):
    out = []
    for doc_id, text in rows:
        words = words_of(doc_id, text, edited)
        runs = runs_of(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * n // q if runs else None
        out.append((doc_id, len(runs), s, n, q, milli, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest()))
    return Counter(out)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def result(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def periodic(rows):
    rng = random.Random(6)
    made = []
    for n in range(120):
        parts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(1, 3)):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33]))]
            length = rng.randint(3 * len(unit), 6 * len(unit) + 2)
            parts.append(" ".join(unit[i % len(unit)] for i in range(length)))
            parts.append(prose(rng, rng.randint(0, 5)))
        made.append((1000 + n, " ".join(parts)))
    made += [(2000, " ".join(["a"] * 3000)), (2001, " ".join(["a", "b"] * 700 + ["a", "c"] * 900)), (None, "x y " * 40)]
    made += [made[3], made[3], (1003, "z " * 50), (2001, "b " * 6), (2002, "b " * 5)]
    return rows + made


def test_against_brute_force(spark, periodic):
    assert result(op.report(frame(spark, periodic))) == brute(periodic)


def test_texts_as_they_stand(spark, periodic):
    assert result(op.report(frame(spark, periodic), edit=None)) == brute(periodic, edited=False)


def test_small_portions_of_tiles_change_nothing(spark, periodic, monkeypatch):
    whole = op.stretches
    monkeypatch.setattr(op, "stretches", lambda words, rule: whole(words, rule, 8))
    some = periodic[-40:]
    assert result(op.report(frame(spark, some))) == brute(some)


def test_runs_far_longer_than_a_tile_are_one(spark):
    rows = [(7, "p q r " * 20_000 + "end"), (8, "only " + "w " * 50_000)]
    got = {r.doc_id: r for r in op.report(frame(spark, rows), edit=None).collect()}
    assert (got[7].n_runs, got[7].start, got[7].length, got[7].period) == (1, 0, 60_000, 3)
    assert (got[8].n_runs, got[8].start, got[8].length, got[8].period) == (1, 1, 50_000, 1)


def test_an_empty_table(no_docs):
    assert op.report(no_docs).collect() == []
