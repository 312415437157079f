import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from conftest import frame

from anchorline.llm import suffixes as op
from anchorline.llm.superkmers import Scheme, repeats


def gone_bytes(rows, window):
    seen = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for raw in texts:
        seen.update(raw[s : s + window] for s in range(len(raw) - window + 1))
    for raw in texts:
        gone = set()
        for s in range(len(raw) - window + 1):
            if seen[raw[s : s + window]] > 1:
                gone.update(range(s, s + window))
        yield raw, gone


def brute(rows, window=400):
    found = []
    for (doc_id, _), (raw, gone) in zip(rows, gone_bytes(rows, window), strict=True):
        spans = sum(i - 1 not in gone for i in gone)
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        found.append((doc_id, len(raw), len(gone), spans, sha256(kept).hexdigest()))
    return Counter(found)


def test_against_brute_force(docs, rows):
    assert Counter(map(tuple, op.report(docs).collect())) == brute(rows)


def test_an_empty_table(no_docs):
    assert op.report(no_docs).collect() == []


def test_passages_of_400_bytes_go_from_every_holder_and_shorter_ones_stay(spark):
    rng = random.Random(5)
    short, long = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (399, 400))
    rows = [(1, f"x{short}x"), (2, f"y{short}y"), (3, f"x{long}x"), (4, f"y{long}y")]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in op.report(frame(spark, rows)).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 3: (400, 1), 4: (400, 1)}


SMALL = Scheme(window=9, k=4, words=False)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_letters(spark, seed):
    rng = random.Random(seed)
    few = [(i, "".join(rng.choice("aab") for _ in range(rng.randint(0, 50)))) for i in range(40)]
    assert Counter(map(tuple, op.report(frame(spark, few), SMALL).collect())) == brute(few, 9)


def all_repeats(texts, window):
    """Maximal repeats of a few texts by definition: string to its places."""
    places = defaultdict(list)
    for number, text in enumerate(texts):
        for a in range(len(text)):
            for b in range(a + window, len(text) + 1):
                places[text[a:b]].append((number, a))
    found = {}
    for string, where in places.items():
        if len(where) < 2:
            continue
        left = [texts[n][a - 1 : a] if a else None for n, a in where]
        right = [texts[n][a + len(string) : a + len(string) + 1] or None for n, a in where]
        if all(None in side or len(set(side)) > 1 for side in (left, right)):
            found[string] = sorted(where)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_the_tree_gives_all_maximal_repeats_with_all_occurrences(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 16))) for _ in range(rng.randint(2, 5))]
    window = 3
    suffixes = sorted(
        (text[a:], text[a - 1] if a else op.OPEN, 1, n, a) for n, text in enumerate(texts) for a in range(len(text))
    )
    longest, found = op.maximal_repeats([s[:3] for s in suffixes], window)
    got = {suffixes[first][0][:length]: sorted(s[3:] for s in suffixes[first : last + 1]) for length, first, last in found}
    assert got == all_repeats(texts, window)
    for i, most in enumerate(longest):
        assert most == max([n for n, first, last in found if first <= i <= last], default=0)


def test_groups_and_their_occurrences(spark):
    shared = "".join(chr(97 + i * i % 26) for i in range(30))
    rows = [(1, "xx" + shared + "yy"), (2, "zz" + shared + "ww"), (3, "qq" + shared[:15] + "vv")]
    groups, places = op.repeat_groups(frame(spark, rows), Scheme(window=12, k=12, words=False))
    # windows of one k-mer: each bucket's string is the window itself, so its repeat is 12 long
    assert {r.length for r in groups.collect()} == {12}
    at = defaultdict(set)
    for r in places.collect():
        at[r.array].add((r.id_key, r.start))
    assert {frozenset(v) for v in at.values()} == {
        frozenset({(1, 2 + i), (2, 2 + i)} | ({(3, 2 + i)} if i <= 3 else set())) for i in range(19)
    }


def test_only_one_string_of_each_kind_travels(spark):
    rows = [(i, "".join(chr(33 + (j * j * 7 + j) % 90) for j in range(900))) for i in range(200)]
    found = repeats(frame(spark, rows), op.BYTES)
    assert found.strings.count() * 50 < found.runs.count()


def test_characters_go_whole_or_stay(spark):
    rows = [(1, "á" + "é" * 300 + "b"), (2, "ã" + "é" * 300 + "c"), (3, None)]
    kept = {r.id_key: r.kept for r in op.without_repeats(frame(spark, rows)).collect()}
    assert kept == {1: "áb", 2: "ãc"}
