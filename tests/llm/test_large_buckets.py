"""Buckets that grow with the corpus because of a passage too rare to be frequent."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import frame, prose
from test_substrings import brute
from test_suffixes import brute as brute_bytes

from anchorline.llm import substrings, suffixes, superkmers


@pytest.fixture
def rows():
    rng = random.Random(4)
    passage, long = prose(rng, 30), prose(rng, 70)
    texts = [" ".join([prose(rng, 60), passage, prose(rng, 60)]) for _ in range(80)]
    return list(enumerate(texts + [prose(rng, 20) + " " + long + " " + prose(rng, 20) for _ in range(3)]))


@pytest.fixture(autouse=True)
def no_frequent_slots(monkeypatch):
    """As in a corpus so large that no passage here has a share worth marking."""
    monkeypatch.setattr(superkmers, "frequent_slots", lambda *_: np.zeros(1 << superkmers.SLOT_BITS, bool))


def largest(found):
    return max(Counter(r.minimiser for r in found.strings.select("minimiser", "content").distinct().collect()).values())


@pytest.mark.parametrize("op, scheme", [(substrings, substrings.WORDS), (suffixes, suffixes.BYTES)])
def test_a_bucket_of_many_strings_is_divided(spark, rows, op, scheme):
    docs = frame(spark, rows)
    whole, divided = superkmers.repeats(docs, scheme), superkmers.repeats(docs, scheme, limit=20)
    assert largest(whole) > 20 >= largest(divided)

    def gone(found):
        return {
            (r.id_key, at) for r in op.removed_spans(found).collect() for span in r.spans for at in range(span["lo"], span["hi"])
        }

    assert gone(divided) == gone(whole) != set()


def test_divided_buckets_against_brute_force(spark, rows, monkeypatch):
    limited = lambda docs, scheme: superkmers.repeats(docs, scheme, limit=20)
    monkeypatch.setattr(substrings, "repeats", limited)
    assert Counter(map(tuple, substrings.report(frame(spark, rows)).collect())) == brute(rows)


def test_divided_buckets_of_bytes_against_brute_force(spark, rows, monkeypatch):
    limited = lambda docs, scheme: superkmers.repeats(docs, scheme, limit=20)
    monkeypatch.setattr(suffixes, "repeats", limited)
    assert Counter(map(tuple, suffixes.report(frame(spark, rows)).collect())) == brute_bytes(rows)
