"""Token files: independent zstandard frames, a document index and a trailing seek table.

A file holds the 32-bit little-endian ids of consecutive documents, end to end, in frames of
``FRAME_BYTES`` of ids that are compressed on their own and carry a checksum.  Behind them stands a
skippable frame with the documents' ids and token counts, and last the seek table of the public
seekable format, also as a skippable frame: sizes and a checksum for each frame, the number of
frames, a descriptor and a magic number.  Any zstandard reader decompresses the whole file to the
ids; a reader that wants some documents finds their frames from the tail.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.llm.common import small_batches, through_table
from wardenlake.llm.tokens import encoder

FRAME_BYTES = 1 << 18
END_ID = 2
# Fixed values of the seekable format: magic numbers of skippable frames and of the footer, descriptor with checksums.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, DESCRIPTOR = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def file_system(folder: str):
    """The pyarrow file system of a folder and the path in it."""
    from pyarrow import fs

    folder = re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+://", folder) else (fs.LocalFileSystem(), folder)


class TokenFileWriter:
    """Writes one file to a stream."""

    def __init__(self, out):
        import zstandard

        self.out, self.waiting, self.frames, self.ids, self.sizes = out, bytearray(), [], [], []
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting += ids
        while len(self.waiting) >= FRAME_BYTES:
            self._frame(bytes(self.waiting[:FRAME_BYTES]))
            del self.waiting[:FRAME_BYTES]

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(bytes(self.waiting))
        present = np.array([i is not None for i in self.ids], np.uint8)
        index = self.compressor.compress(struct.pack("<Q", len(self.ids)) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes() + present.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenFileReader:
    """Reads documents of one file; only the frames that hold them are decompressed."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        end = source.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._bytes(end - 9, 9))
        if magic != FOOTER_MAGIC or descriptor != DESCRIPTOR:
            raise ValueError("not a token file")
        table = np.frombuffer(self._bytes(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.sums = table[:, 2]
        magic, size = struct.unpack("<II", self._bytes(int(self.packed[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("document index is missing")
        index = self.decompressor.decompress(self._bytes(int(self.packed[-1]) + 8, size))
        (n,) = struct.unpack_from("<Q", index)
        ids, sizes = np.frombuffer(index, "<i8", n, 8), np.frombuffer(index, "<u8", n, 8 + 8 * n).astype(np.int64)
        present = np.frombuffer(index, np.uint8, n, 8 + 16 * n)
        self.ids = [int(i) if p else None for i, p in zip(ids, present)]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.kept = (-1, b"")

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.kept[0] != k:
            raw = self.decompressor.decompress(self._bytes(int(self.packed[k]), int(self.packed[k + 1] - self.packed[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.kept = (k, raw)
        return self.kept[1]

    def tokens(self, place: int) -> bytes:
        """The ids of the document at a place of the index."""
        a, b = 4 * int(self.first[place]), 4 * int(self.first[place + 1])
        k, parts = int(np.searchsorted(self.raw, a, "right")) - 1, []
        while a < b:
            to = min(b, int(self.raw[k + 1]))
            parts.append(self.frame(k)[a - int(self.raw[k]) : to - int(self.raw[k])])
            a, k = to, k + 1
        return b"".join(parts)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents, each with the end id behind it, in ascending key order; returns the manifest.

    Null texts are empty; null keys come first; equal keys stand in any order.  A file has the rows of
    one range of keys.  Each attempt of a task writes a file of its own name and moves it into place when
    complete; the manifest, itself a table in the shared folder, names the files that count:
    (file_no, path, documents, tokens, first_key, last_key).  Very long texts are written whole, over as
    many frames as they need; an empty table gives an empty manifest and no file; other columns are left
    aside, whatever their names.
    """
    small_batches(docs.sparkSession)
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange("k").sortWithinPartitions("k")

    def write(batches):
        system, base = file_system(folder)
        number, writer, tokens = TaskContext.get().partitionId(), None, 0
        fields = ["file_no", "path", "documents", "tokens", "first_key", "last_key"]
        name = f"{base}/part-{number:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows and writer is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{name}.partial", compression=None)
                writer = TokenFileWriter(out)
            for k, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(batch.column(1))):
                ids = ids.astype("<u4").tobytes() + END_ID.to_bytes(4, "little")
                writer.add(k, ids)
                tokens += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            system.move(f"{name}.partial", f"{name}.tokens")
            row = [number, f"{name.removeprefix(base).lstrip('/')}.tokens", len(writer.ids), tokens, writer.ids[0], writer.ids[-1]]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=fields)

    return through_table(ordered.mapInArrow(write, "file_no long, path string, documents long, tokens long, first_key long, last_key long"), "manifest")


def may_hold(wanted: list[int | None], first: int | None, last: int | None) -> bool:
    """Whether a file whose keys go from ``first`` to ``last``, nulls first, may hold one of ``wanted``: known keys in order, then null."""
    if first is None and wanted and wanted[-1] is None:
        return True
    known = len(wanted) - (bool(wanted) and wanted[-1] is None)
    at = 0 if first is None else bisect_left(wanted, first, 0, known)
    return last is not None and at < known and wanted[at] <= last


def read_tokens(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of those in ``wanted``, from their files.

    ``start`` counts the ids of all documents before.  The manifest has one small row a file; files whose
    range of keys holds none of ``wanted`` are not opened, and of the others only the frames of wanted
    documents are decompressed.  A null in ``wanted`` stands for documents without a key, keys that don't
    occur give nothing, and an empty manifest or list gives no rows.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a number of partitions of its own, for the few bytes of a manifest stand for whole files
    files = manifest.withColumn("start", before).select("path", "start", "first_key", "last_key").repartition(max(1, 2 * manifest.count()), "path")
    only = None if wanted is None else frozenset(wanted)
    order = None if wanted is None else [*sorted(only - {None}), *only & {None}]

    def read(batches):
        system, base = file_system(folder)
        for batch in batches:
            for path, start, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if order is not None and not may_hold(order, first, last):
                    continue
                with system.open_input_file(f"{base}/{path}") as source:
                    file, rows, size = TokenFileReader(source), [], 0
                    for place, doc_id in enumerate(file.ids):
                        if only is None or doc_id in only:
                            ids = file.tokens(place)
                            rows.append((doc_id, start + int(file.first[place]), len(ids) // 4, ids))
                            size += len(ids)
                        if rows and (size > 1 << 22 or place + 1 == len(file.ids)):
                            columns = list(zip(*rows))
                            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids"])
                            rows, size = [], 0

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
