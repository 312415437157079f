"""Helpers shared by the text operators: tables, staging, Arrow slices, token hashes.

Python work happens inside ``mapInArrow`` on slices of half a megabyte, so a task
never holds more than one Arrow batch of ``BATCH_BYTES`` and one slice (or one long
text).
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path
from zipfile import ZipFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_folder, staged

#: Bytes of text that one vectorised step works on; a longer text is one step.
SLICE_BYTES = 1 << 19
#: Bytes of rows that Spark hands to a worker at a time; a longer row comes alone.
BATCH_BYTES = 4 << 20
#: Stands in for a missing doc_id: such rows come after all others.
NO_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound Arrow batches.

    Left alone, a batch is ten thousand rows, however long their texts are, and is held
    several times over on both sides of the pipe.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_anchorline_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="anchorline-")) / "anchorline.zip"
    with ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    context._anchorline_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return staged(df, f"{shared_folder(df.sparkSession)}/anchorline-llm", name)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_tasks_of(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in no more tasks than ``rows`` counted rows need at ``each`` rows a task."""
    return df.coalesce(max(1, min(parallelism(df.sparkSession), -(-rows // each))))


def row_keys() -> tuple[Column, Column]:
    """A never-NULL id and a hash of the text: together they tell repeated ids apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")


def keyed_text(docs: DataFrame) -> DataFrame:
    """``doc_id, id_key, text_key, text``; rows equal in both keys get equal results."""
    ship(docs.sparkSession)
    id_key, text_key = row_keys()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        id_key.alias("id_key"),
        text_key.alias("text_key"),
        F.col("text"),
    )


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """A column by its whole name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


class Slice:
    """Consecutive rows of a batch: their text as one byte array with offsets."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, offsets: np.ndarray, data: np.ndarray):
        self.batch, self.lo, self.hi = batch, lo, hi
        self.data = data[offsets[lo] : offsets[hi]]
        self.offsets = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)

    def __len__(self) -> int:
        return self.hi - self.lo

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def column(self, name: str) -> pa.Array:
        at = self.batch.schema.get_field_index(name)
        return self.batch.column(at).slice(self.lo, len(self))

    def numbers(self, name: str) -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)

    def texts(self) -> Iterator[bytes]:
        raw = self.data.tobytes()
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield raw[a:b]


def give_back() -> None:
    """Unused memory of Arrow and of the C heap goes back to the system: the worker lives on."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's ``malloc_trim``, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[Slice]:
    """The batches in slices of about ``budget`` bytes of ``column``; a NULL is empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        values = values.cast(pa.large_binary())
        if values.null_count:
            values = values.fill_null(b"")
        _, at, raw = values.buffers()
        offsets = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(values):
            hi = int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1
            hi = min(max(hi, lo + 1), len(values))
            yield Slice(batch, lo, hi, offsets, data)
            lo = hi
    give_back()


def byte_class(pattern: bytes) -> np.ndarray:
    """A 256-entry membership table from pairs of first and last byte."""
    found = np.zeros(256, bool)
    for first, last in zip(pattern[::2], pattern[1::2], strict=True):
        found[first : last + 1] = True
    return found


#: ASCII white space; everything else belongs to a word.
NOT_SPACE = ~byte_class(b"\x20\x20\x09\x0d")
#: digits, lower-case letters and every byte of a non-ASCII character
ALNUM = byte_class(b"\x30\x39\x61\x7a\x80\xff")
#: ASCII A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the texts."""
    inside = members[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]  # a word ends where its text ends
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


#: Powers a worker keeps: enough for one slice.
KEPT_POWERS = 1 << (SLICE_BYTES + 1024).bit_length()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_kept_powers = lru_cache(maxsize=2)(_powers)


def powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers; more than a slice needs are made anew and not kept."""
    return _kept_powers(KEPT_POWERS, base)[:n] if n <= KEPT_POWERS else _powers(n, base)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Hashes of any span of a token array in constant time."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            terms = tokens.astype(np.uint64) + np.uint64(0x51ED27)
            terms *= powers(n, _BASE)
            np.cumsum(terms, out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        if len(h):
            h *= powers(len(self.sums), _BASE_INVERSE)[starts]
            h += (ends - starts).astype(np.uint64)
        return mixed(h)

    def windows(self, width: int) -> np.ndarray:
        """The hash of every span of ``width`` tokens, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = self.sums[width:] - self.sums[:-width]
        h *= powers(n, _BASE_INVERSE)
        h += np.uint64(width)
        return mixed(h)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefix(data).spans(starts, ends)


def passing(docs: DataFrame, chooser: Callable[[], Callable[[Slice], list[bool]]]) -> DataFrame:
    """The rows, whole, whose text a task's ``chooser()`` accepts; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = chooser()
        for part in slices(batches):
            yield part.batch.slice(part.lo, len(part)).filter(pa.array(choose(part), pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches that are sorted by ``key``, cut so that no group is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.argmax(keys == keys[-1]))
        if cut:  # the last group may go on in the next batch
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
