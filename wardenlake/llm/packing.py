"""Packing token pieces into sequences by minimum bin slack.

Only how many pieces have each length matters to the packing, so the plan is made from at most
``capacity`` counts, whatever the number of documents.  For each bin the longest length left is
taken and a subset-sum table over the lengths left, one bit a sum, finds the combination that fills
the bin furthest; the combination is used as often as the counts allow.  Each piece then finds its
place by arithmetic from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.llm.common import send, small_batches, through_table
from wardenlake.llm.tokens import encoder

CAPACITY = 1024
END_ID = 2
PIECES_A_GROUP = 5000


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths from the multiset that add up as close to ``room`` as any do, long ones first."""
    if room <= 0:
        return []
    sums, steps = 1, []
    inside = (1 << (room + 1)) - 1
    for length in map(int, np.flatnonzero(counts[: room + 1])[::-1]):
        for _ in range(min(int(counts[length]), room // length)):
            more = (sums | sums << length) & inside
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
        if sums >> room:
            break
    at, chosen = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> at & 1:  # the sum needs this length
            chosen.append(length)
            at -= length
    return chosen


@dataclass
class Plan:
    """Ranks ``first`` .. of ``length`` go to sequences from ``sequence`` on, ``uses`` to each, from offset ``offset``."""

    length: np.ndarray
    first: np.ndarray
    uses: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 44 | self.first
        row = np.searchsorted(key, length.astype(np.int64) << 44 | rank, "right") - 1
        within = rank - self.first[row]
        return self.sequence[row] + within // self.uses[row], self.offset[row] + within % self.uses[row] * length


def minimum_slack_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """A plan for counts[length] pieces of each length from 1 to capacity."""
    left, taken, rows, sequence = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), [], 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        bin_ = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // uses).min())
        offset = 0
        for length, n in zip(lengths[::-1], uses[::-1]):
            rows.append((int(length), int(taken[length]), int(n), sequence, offset))
            offset += int(length) * int(n)
            left[length] -= times * n
            taken[length] += times * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=sequence)


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids with the end id, cut so that only the first piece is shorter than capacity.

    Null and empty texts are one piece with the end id only; very long texts are cut into as many
    pieces as they need.  Rows that repeat a key or have none are cut each on their own.  Other
    columns are ignored whatever their names, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = docs.select(F.col(key).cast("long").alias(key)).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def cut(batches):
        for batch in batches:
            keys, numbers, starts, lengths, sums = [], [], [], [], []
            for k, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(batch.column(1))):
                ids = ids.astype("<u4").tobytes() + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                to = n - (n - 1) // capacity * capacity
                at, piece = 0, 0
                while at < n:
                    keys.append(k)
                    numbers.append(piece)
                    starts.append(at)
                    lengths.append(to - at)
                    sums.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, to, piece = to, to + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))], names=schema.names)

    return docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(cut, schema)


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that have a key, piece, start and length from 1 to capacity.

    Ranks among pieces of a length are counted in groups of a few thousand pieces by a hash of the
    piece, whose sizes are summed up before; so a length that many pieces share is spread like any other.
    All rows are placed, also those that repeat another or have no key; which of equal pieces comes
    first is of no matter.  Input columns called sequence_id or offset are replaced, all others stay whatever their
    names.  An empty table gives no rows.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    schema = pieces.select(kept).schema.add("sequence_id", "long").add("offset", "long")
    named = {c: f"c{i}" for i, c in enumerate(kept)}
    pieces = through_table(pieces.select(*[F.col(c).alias(name) for c, name in named.items()]), "pieces")
    key, piece, start, length = (named[c] for c in (key, "piece", "start", "length"))
    counts, total = np.zeros(capacity + 1, np.int64), 0
    for row in pieces.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[row[length]] = row["n"]
        total += row["n"]
    receive = send(spark, minimum_slack_plan(counts, capacity))
    groups = max(1, -(-total // PIECES_A_GROUP))
    spread = pieces.withColumn("group", F.pmod(F.xxhash64(key, piece), F.lit(groups)))
    sizes = spread.groupBy(length, "group").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(length).orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(length, "group", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(length, "group").orderBy(F.col(key).asc_nulls_first(), piece, start))
    ranked = spread.withColumn("rank", own - 1).join(sizes, [length, "group"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    ranked = ranked.select(*pieces.columns, "rank")

    def place(batches):
        plan = receive()
        for batch in batches:
            where = batch.schema.names.index(length)
            sequence, offset = plan.place(batch.column(where).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return ranked.mapInArrow(place, schema)
