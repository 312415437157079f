from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anchorline.llm import packing as op

tokenizers = pytest.importorskip("tokenizers")


def expected_pieces(rows):
    tokenizer = tokenizers.Tokenizer.from_file(op.vocabulary_path())
    found = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), op.CAPACITY)):
            own = ids[at : at + op.CAPACITY]
            found.append((doc_id, piece, at, len(own), crc32(np.array(own, "<u4").tobytes())))
    return found


def test_every_token_has_one_place(docs, rows):
    got = op.pack(docs).collect()
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert pieces == Counter(expected_pieces(rows))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= op.CAPACITY
    assert len(sequences) <= 1.03 * sum(r.length for r in got) / op.CAPACITY + 1


def test_an_empty_table(no_docs):
    assert op.pack(no_docs).collect() == []


def test_chunks_are_tokenised_as_whole_texts():
    odd = [
        "İstanbul ΟΔΥΣΣΕΥΣ Σ it's don't I'M  a\tb\r\nc ﬁne ½ 12,5 <|endoftext|>x <|ENDOFTEXT|> naïve… 한국어! ́abc K",
        "a.b.c... !!! ?a? A.B, ,.;",
        "",
        " \n ",
        "one two　three four",
    ]
    tokenizer = tokenizers.Tokenizer.from_file(op.vocabulary_path())
    chunked = op.ChunkTokenizer(op.vocabulary_path())
    for text, ids in zip(odd, chunked.ids([t.encode() for t in odd]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_are_looked_up_in_steps(monkeypatch):
    monkeypatch.setattr(op, "CHUNKS_AT_ONCE", 3)
    monkeypatch.setattr(op, "REMEMBERED", 4)
    odd = ["", "naïve,b(c)[d] é!à? ×.÷,ñ;\u0301", "", " ", "x<|endoftext|>y,Z <|END.", "don't, 'S,a'LL;", "\n\nlast…,"]
    tokenizer = tokenizers.Tokenizer.from_file(op.vocabulary_path())
    chunked = op.ChunkTokenizer(op.vocabulary_path())
    for _ in range(2):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in chunked.ids([t.encode() for t in odd])]
        assert got == [tokenizer.encode(text, add_special_tokens=False).ids for text in odd]
        assert len(chunked.known) <= 4 + 1 + 3
    assert list(chunked.ids([])) == []
    assert list(chunked.ids([b""])) == [b""]


def test_punctuation_does_not_multiply_what_a_worker_remembers():
    words = ["ab" * n + end for n in range(1, 30) for end in ("c", "é")]
    marks = [",", ";", "!!", "***", "(", "&c"]
    chunked = op.ChunkTokenizer(op.vocabulary_path())
    text = " ".join(word + mark for word in words for mark in ["", *marks])
    tokenizer = tokenizers.Tokenizer.from_file(op.vocabulary_path())
    assert np.frombuffer(*chunked.ids([text.encode()]), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    remembered = sum(len(found) for found in vars(chunked).values() if isinstance(found, dict))
    assert remembered <= 1 + len(words) + len(marks)  # one per word and mark before, and the words once more


def test_two_smaller_pieces_replace_the_smallest():
    # greedy: 6, then 3 fits best and 1 is left over; 2 + 2 fill the gap exactly
    assert op.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def least_sequences(histogram, capacity):
    """No packing has fewer: at most m pieces above capacity / (m + 1) share a sequence,
    and pieces above capacity - k share with none of k or more."""
    best = max(-(-sum(c for n, c in histogram.items() if n * (m + 1) > capacity) // m) for m in range(1, capacity + 1))
    for k in range(capacity // 2 + 1):
        alone = sum(c for n, c in histogram.items() if n > capacity - k)
        wide = {n: c for n, c in histogram.items() if capacity / 2 < n <= capacity - k}
        small = sum(n * c for n, c in histogram.items() if k <= n <= capacity / 2)
        gaps = sum(c * (capacity - n) for n, c in wide.items())
        best = max(best, alone + sum(wide.values()) + max(0, -(-(small - gaps) // capacity)))
    return best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), min_size=1, max_size=30))
def test_fillings_use_every_piece_once(histogram):
    fillings = op.best_two_fit(histogram, 40)
    used = Counter()
    for filling, times in fillings:
        assert sum(filling) <= 40 and times > 0
        for length in filling:
            used[length] += times
    assert used == Counter(histogram)
    sequences = sum(times for _, times in fillings)
    assert sequences <= 1.25 * least_sequences(histogram, 40) + 2


def test_places_cover_all_ranks():
    histogram = {5: 7, 4: 9, 3: 20, 1: 11}
    table = op.places(op.best_two_fit(histogram, 10))
    assert len(table) <= 40
    firsts = table[table["rank"] == 0]
    assert sorted(firsts["length"]) == sorted(histogram)
