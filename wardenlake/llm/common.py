"""What the operators of this subpackage share: folds, Arrow buffers, word hashes, worker caches, shared folders."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.session import ensure_checkpoint_dir

BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fold(key: Column, parts: int) -> Column:
    """Remainder of the crc32 of a key's decimal text."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def worker_cache(name: str, make: Callable):
    """A value that the Python worker keeps from task to task; it only saves work and is never a result."""
    store = sys.modules.setdefault("_wardenlake_worker_cache", types.ModuleType("_wardenlake_worker_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one in ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back, so that later jobs don't compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete the files behind frames of ``through_table`` once nothing reads them any more."""
    for frame in frames:
        hadoop = frame.sparkSession._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def _byte_tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, A-Z as a-z if ``lower``, and which bytes are white space."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    return values, white


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashed words (lower-cased unless asked otherwise) ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, in order.

    ``hashes`` holds one 64-bit hash a word, ``first`` the word offset of each row (one more at the end);
    ``start`` and ``end`` are byte positions in ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        values, white = _byte_tables(lower)
        self.data = data
        starts, ends, hashes = [], [], []
        for a, b in _blocks(data, offsets, white):
            part = data[a:b]
            word = ~white[part]
            opens = word.copy()
            opens[1:] &= ~word[:-1]
            rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
            opens[rows] = word[rows]
            closes = word.copy()
            closes[:-1] &= ~word[1:] | opens[1:]
            s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            powers, inverses = _powers(b - a)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[part] * powers[: b - a], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * inverses[s]))
            starts.append(s + a)
            ends.append(e + a)
        self.start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        return tables[0], tables[1]

    if n > 4 * BLOCK_BYTES:
        return make(n)
    return worker_cache(f"powers_{BLOCK_BYTES}", lambda: make(4 * BLOCK_BYTES))


def _blocks(data: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut the bytes at row starts or white space into pieces of about BLOCK_BYTES; a longer word stays whole."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + BLOCK_BYTES, n)
        if to < n:
            row = offsets[np.searchsorted(offsets, to, "right") - 1]
            if row > at:
                to = int(row)
            else:
                span = 1 << 12
                while to < n and not white[data[to - 1]]:
                    hit = np.flatnonzero(white[data[to : to + span]])
                    to = to + int(hit[0]) + 1 if len(hit) else min(to + span, n)
                    span *= 2
                # the word may also end with its row
                row = offsets[np.searchsorted(offsets, at + BLOCK_BYTES, "left")]
                to = min(to, int(row)) if row > at else to
        yield at, to
        at = to


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each element, from the row offsets."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def table(schema: pa.Schema | list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(schema))


def send(spark: SparkSession, value) -> Callable:
    """Broadcast a model of bounded size; the returned function gives it in a task.

    Classes of this package travel by value, which plain broadcasts of objects don't do.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


class HashIndex:
    """Places of 64-bit keys in order of arrival, looked up many at a time: -1 where a key is absent."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys, self.size = np.zeros(1024, np.uint64), 0
        self._lay_out(11)
        if keys is not None:
            self.add(keys)

    def _lay_out(self, bits: int) -> None:
        self.bits, self.slots, self.steps = bits, np.full(1 << bits, -1, np.int32), 0
        self._enter(np.arange(self.size))

    def _slot(self, wanted: np.ndarray, step: int) -> np.ndarray:
        return (((wanted * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & (len(self.slots) - 1)

    def _enter(self, left: np.ndarray) -> None:
        step = 0
        while len(left):
            at = self._slot(self.keys[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1
        self.steps = max(self.steps, step)

    def add(self, keys: np.ndarray) -> None:
        """Append keys that are absent, each once."""
        size = self.size + len(keys)
        if size > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.size], np.zeros(size + size // 4 - self.size, np.uint64)])
        self.keys[self.size : size] = keys
        self.size = size
        if 2 * size > len(self.slots):
            self._lay_out(int(2 * size).bit_length() + 1)
        else:
            self._enter(np.arange(size - len(keys), size))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int32)
        open_ = np.arange(len(wanted))
        for step in range(self.steps):
            asked = wanted[open_]
            at = self.slots[self._slot(asked, step)]
            hit = (at >= 0) & (self.keys[at] == asked)
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (at >= 0)]
            if not len(open_):
                break
        return out
