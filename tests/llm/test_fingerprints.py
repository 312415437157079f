from hashlib import sha256

import numpy as np
import pytest

from anchorline.llm import fingerprints as op


def chosen(text, k=op.K, s=op.S):
    """Closed syncmers by definition, on the same hashes."""
    from anchorline.llm.common import Prefix

    inner = Prefix(np.frombuffer(text.encode("utf-32-le"), "<u4")).windows(s)
    found = []
    for at in range(len(text) - k + 1):
        window = inner[at : at + k - s + 1]
        if min(window) in (window[0], window[-1]):
            found.append(at)
    return found


def test_syncmers_are_those_whose_smallest_inner_string_is_at_an_edge(plain):
    for text in [t for t in plain.values() if t][:20]:
        at, _ = op.syncmers(text)
        assert at.tolist() == (chosen(text) or [0])


def test_an_anchor_does_not_depend_on_what_is_around_it(plain):
    text = plain[60]
    at, hashes = op.syncmers(text)
    moved, moved_hashes = op.syncmers("in front of it " + text)
    shifted = dict(zip((moved - 15).tolist(), moved_hashes.tolist(), strict=True))
    assert all(shifted[a] == h for a, h in zip(at.tolist(), hashes.tolist(), strict=True))


def test_likeness():
    text = " ".join(f"word{i * i}" for i in range(400))
    mark = op.Fingerprint(text)
    assert mark.likeness(op.Fingerprint(text)) == 1
    assert mark.likeness(op.Fingerprint("something else entirely, and long enough to have anchors")) == 0
    half = mark.likeness(op.Fingerprint(text[: len(text) // 2]))
    assert 0.35 < half < 0.65
    assert op.Fingerprint("").likeness(op.Fingerprint(None)) == 1
    assert op.Fingerprint("").likeness(mark) == 0
    tail, front = text[2000:], text[:2000]
    assert mark.likeness(op.Fingerprint(tail + front)) < 0.8  # moved text is out of order


def test_report_against_the_definition(plain_docs, plain):
    got = {r.doc_id: r for r in op.report(plain_docs).collect()}
    ids = sorted(plain, reverse=True)
    assert sorted(got) == sorted(plain)
    for doc_id, following in zip(ids, ids[1:] + ids[:1], strict=True):
        text, after = plain[doc_id] or "", plain[following] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        row = got[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == sha256(new.encode()).hexdigest()
        assert row.fingerprint == str(op.Fingerprint(text))
        assert row.edited_fingerprint == str(op.Fingerprint(new))
        assert row.near_edited == op.Fingerprint(text).likeness(op.Fingerprint(new))
        assert row.near_next == op.Fingerprint(text).likeness(op.Fingerprint(after))


def test_repeated_and_missing_ids_and_an_empty_table(docs, no_docs, rows):
    got = op.report(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.doc_id is None for r in got) == 2
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault(text or "", set()).add(doc_id)
    assert op.report(no_docs).collect() == []


@pytest.mark.parametrize("partitions", ["1", "3"])
def test_ranges_do_not_change_the_result(spark, plain_docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(op.report(plain_docs).collect())
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(op.report(plain_docs).collect()) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_local_edit_in_a_long_text_is_seen():
    """All anchors count: one changed word of a long text changes print and likeness."""
    text = " ".join(f"word{i * i % 99991}" for i in range(13_000))
    assert len(text) > 115_000
    new = text.replace(" word25 ", " other words entirely here ", 1)
    one, other = op.Fingerprint(text), op.Fingerprint(new)
    assert text != new and str(one) != str(other)
    assert 0.99 < one.likeness(other) < 1
    assert len(str(one)) == 16 + 16 * op.SIZE


def test_a_passage_that_long_texts_share_is_seen():
    words = [f"w{i * i % 7919}x{i}" for i in range(9_000)]
    one = op.Fingerprint(" ".join(words[:5_000]))
    other = op.Fingerprint(" ".join(words[4_800:]))
    assert 0.005 < one.likeness(other) < 0.05


def test_likeness_against_its_definition(plain):
    """All common anchors and the longest chain by the quadratic rule."""

    def anchors(text):
        at, hashes = op.syncmers(text)
        found = {}
        for a, h in zip(at.tolist(), (hashes >> np.uint64(32)).tolist(), strict=True):
            found.setdefault(h, a)
        return found

    texts = [t for t in plain.values() if t and len(t) < 1500][:14]
    for x, y in zip(texts, texts[1:] + texts[:1], strict=True):
        y = x[: len(x) // 2] + y
        a, b = anchors(x), anchors(y)
        places = [b[h] for h in sorted(a.keys() & b.keys(), key=a.get)]
        best = []
        for i, p in enumerate(places):
            best.append(1 + max((best[j] for j in range(i) if places[j] < p), default=0))
        assert op.Fingerprint(x).likeness(op.Fingerprint(y)) == max(best, default=0) / len(a.keys() | b.keys())
