"""Best-fit packing of tokenised documents into sequences, by best-two-fit.

A document is its token ids and one separator.  Only documents longer than a
sequence are cut, into whole sequences and a rest.  The pieces are then packed:

* a sequence is opened with the longest piece left and filled greedily with the
  longest piece that fits;
* then its smallest piece is taken out again if two unpacked pieces fit the gap
  so widened more tightly, and so on while that helps.

Pieces of one length are interchangeable, so the packing is worked out on the
*histogram* of lengths, which has at most ``capacity`` entries however large the
corpus is.  A filling is repeated as often as the histogram allows before the
next is sought, so there are few distinct fillings and many sequences.  The
resulting table says which rank of which length goes where; Spark ranks the
pieces within each length (salted, so that a length that holds most pieces is
ranked in bounded parts) and looks their places up.

Texts are tokenised in chunks between blanks and line feeds, and between a letter
and ASCII punctuation behind it: this tokenizer never joins characters across
them.  Each distinct chunk is tokenised once as long as a worker remembers it.

Defined results: a NULL text is the separator alone, as the empty text;
repeated rows are packed once each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise
from operator import add, not_
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_class, record_batch, slices, stage
from .sharding import numbered

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "word_bpe_49k.json"
#: marks a word's last token in the vocabulary
WORD_END = "</w>"
#: punctuation that is a word of its own behind letters
BEHIND = ".,;:!?"
#: the one letter that Python lowers by its place in the word
CAPITAL_SIGMA = "\u03a3"
#: Chunks a worker remembers, some fifty megabytes; its memory is emptied when there are more.
REMEMBERED = 200_000
#: Chunks that are looked up at a time.
CHUNKS_AT_ONCE = 1 << 17
_SMALL = byte_class(b"az")
_PUNCTUATION = byte_class(b"\x21\x2f\x3a\x40\x5b\x60\x7b\x7e")
_BREAK = byte_class(b"  \n\n")
#: second bytes of the letters from U+00C0 to U+00FF, without the two signs among them
_LATIN = byte_class(b"\x80\x96\x98\xb6\xb8\xbf")
SALTS = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class ChunkTokenizer:
    """Token ids of texts as little-endian 32-bit bytes.

    Most chunks are letters with some punctuation behind.  The tokenizer lowers
    letters one by one, takes a run of them as one word, punctuation behind it as
    another, and marks each word's last token.  So many distinct runs of letters
    are tokenised in one call and told apart by those marks; all other chunks are
    tokenised as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core; further threads cost memory and CPU seconds
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[number for token, number in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {b"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in encoded]

    def words(self, words: list[str]) -> dict[str, bytes]:
        known: dict[str, bytes] = {}
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        joined = self.tokenizer.encode_batch_fast([" ".join(some) for some in groups], add_special_tokens=False)
        for some, one in zip(groups, joined, strict=True):
            ids = np.array(one.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) == len(some):
                found = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                found = self.whole(some)
            known.update(zip(some, found, strict=True))
        return known

    def learn(self, chunks: list[bytes]) -> None:
        texts = [chunk.decode() for chunk in chunks]
        cores = [text.rstrip(BEHIND) for text in texts]
        lows = list(map(str.lower, cores))
        plain = [low.isalpha() and CAPITAL_SIGMA not in core for low, core in zip(lows, cores, strict=True)]
        tails = [text[len(core) :] for text, core in zip(texts, cores, strict=True)]
        behind = list(set(compress(tails, plain)))
        tail_ids = dict(zip(behind, self.whole(behind), strict=True))
        word_ids = self.words(list(set(compress(lows, plain))))
        found = map(add, map(word_ids.get, compress(lows, plain)), map(tail_ids.get, compress(tails, plain)))
        self.known.update(zip(compress(chunks, plain), found, strict=True))
        other = list(map(not_, plain))
        self.known.update(zip(compress(chunks, other), self.whole(list(compress(texts, other))), strict=True))

    def looked_up(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, one after the other, and how many each has."""
        coded = chunks.dictionary_encode()
        _, bounds, raw = coded.dictionary.buffers()
        bounds = np.frombuffer(bounds, np.int64)[: len(coded.dictionary) + 1].tolist()
        raw = raw.to_pybytes()
        distinct = [raw[a:b] for a, b in pairwise(bounds)]
        if len(self.known) > REMEMBERED:
            self.forget()
        found = list(map(self.known.get, distinct))
        if new := [chunk for chunk, ids in zip(distinct, found, strict=True) if ids is None]:
            self.learn(new)
            found = list(map(self.known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(found), "<u4")
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(counts) - counts
        order = coded.indices.to_numpy()
        each = counts[order]
        at = np.repeat(starts[order] - (np.cumsum(each) - each), each)
        at += np.arange(len(at))
        return flat[at], each

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        raw = b"\n".join(texts)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        low = LOWER[data]
        letter = _SMALL[low]
        letter[1:] |= _LATIN[low[1:]] & (low[:-1] == 0xC3)
        cut = np.zeros(len(low), bool)
        cut[1:] = letter[:-1] & _PUNCTUATION[low[1:]]
        if b"<|" in raw:  # what could be or become the name of a special token stays as it is
            for text, end in zip(texts, ends.tolist(), strict=True):
                if b"<|" in text:
                    low[end - len(text) : end] = data[end - len(text) : end]
                    cut[end - len(text) : end] = False
        gap = _BREAK[low]
        stops = np.append(np.flatnonzero(gap | cut), len(low))  # every chunk's end
        bounds = np.searchsorted(stops, ends)  # the last chunk of every text
        offsets = np.append(0, stops)
        offsets[2:] -= np.cumsum(gap[stops[:-1]])
        shown = pa.py_buffer(low[~gap])
        parts, counts = [], []
        for at in range(0, len(stops), CHUNKS_AT_ONCE):
            some = offsets[at : at + CHUNKS_AT_ONCE + 1]
            chunks = pa.Array.from_buffers(pa.large_binary(), len(some) - 1, [None, pa.py_buffer(some), shown])
            found, each = self.looked_up(chunks)
            parts.append(found.tobytes())
            counts.append(each)
        whole = b"".join(parts)
        places = 4 * np.cumsum(np.concatenate(counts))
        last = 0
        for end in places[bounds].tolist():
            yield whole[last:end]
            last = end


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> ChunkTokenizer:
    """One per worker, so that tasks after the first know most chunks."""
    return ChunkTokenizer(path)


def _cut(path: str, capacity: int):
    separator = np.array([SEPARATOR], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for part in slices(batches):
            out: list[list] = [[] for _ in _SCHEMA]
            doc_ids = part.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, tokenizer.ids(list(part.texts())), strict=True):
                ids += separator
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(own) // 4, crc32(own)), strict=True):
                        column.append(value)
            yield record_batch(_SCHEMA, *out)

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_cut(path or vocabulary_path(), capacity), PIECES)


class Histogram:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.lengths = sorted(n for n, c in counts.items() if c > 0)

    def longest(self, room: int, taken: dict[int, int]) -> int:
        """The longest length up to ``room`` with a piece left beyond ``taken``; 0 if none."""
        at = bisect_right(self.lengths, room) - 1
        while at >= 0:
            length = self.lengths[at]
            if self.left[length] > taken.get(length, 0):
                return length
            at -= 1
        return 0

    def best_two(self, room: int, taken: dict[int, int]) -> tuple[int, int]:
        """Two lengths with pieces left whose sum is the largest up to ``room``."""
        best = (0, 0)
        for first in self.lengths:
            if 2 * first > room:  # the shorter one of the two
                break
            if self.left[first] <= taken.get(first, 0):
                continue
            second = self.longest(room - first, {**taken, first: taken.get(first, 0) + 1})
            if second and first + second > sum(best):
                best = (first, second)
                if sum(best) == room:
                    break
        return best

    def take(self, filling: dict[int, int]) -> int:
        """Take a filling as often as it goes; how often."""
        times = min(self.left[length] // n for length, n in filling.items())
        for length, n in filling.items():
            self.left[length] -= n * times
            if not self.left[length]:
                self.lengths.remove(length)
        return times


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fillings (lengths in order) and how many sequences have each."""
    rest = Histogram(histogram)
    fillings = []
    while rest.lengths:
        filling: list[int] = []
        taken: dict[int, int] = {}
        room = capacity
        while length := rest.longest(room, taken):
            filling.append(length)
            taken[length] = taken.get(length, 0) + 1
            room -= length
        while room and len(filling) > 1:
            smallest = filling[-1]
            without = {**taken, smallest: taken[smallest] - 1}
            pair = rest.best_two(room + smallest, without)
            if sum(pair) <= smallest:
                break
            filling = sorted([*filling[:-1], *pair], reverse=True)
            room += smallest - sum(pair)
            taken = {length: filling.count(length) for length in filling}
        fillings.append((filling, rest.take(taken)))
    return fillings


def places(fillings: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For ranges of ranks of a length: first sequence, pieces in each, first offset.

    Bounded by the histogram: a filling is left when one of its lengths is all
    but used up.
    """
    rows = []
    next_rank: dict[int, int] = {}
    sequence = 0
    for filling, times in fillings:
        offset = 0
        for length in dict.fromkeys(filling):
            each = filling.count(length)
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, each, offset))
            next_rank[length] = rank + each * times
            offset += each * length
        sequence += times
    frame = pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"])
    return frame.sort_values(["length", "rank"], ignore_index=True)


def _placer(table: pd.DataFrame):
    stride = 1 << 48  # above any rank
    order = table["length"].to_numpy(np.int64) * stride + table["rank"].to_numpy(np.int64)
    sequence, each, offset, first = (table[c].to_numpy(np.int64) for c in ("sequence", "each", "offset", "rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(order, n * stride + r, "right") - 1
        number = r - first[at]
        return pd.DataFrame(
            {"sequence_id": sequence[at] + number // each[at], "offset": offset[at] + (number % each[at]) * n}
        )

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = stage(token_pieces(docs, capacity, path), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # <= capacity rows
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    place = _placer(places(best_two_fit(counts, capacity)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    ranked = numbered(salted, "length", "salt", ["doc_id", "piece", "ids_crc32"], "rank")
    return ranked.withColumn("place", place("length", "rank")).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.col("place.sequence_id").alias("sequence_id"),
        F.col("place.offset").alias("offset"),
    )
