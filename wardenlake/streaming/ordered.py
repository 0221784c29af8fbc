"""Base of the stateful processors whose answer depends on event order.

Rows wait in state until the watermark has passed their range of event time and are
then handled in event-time order, so late or shuffled arrival gives the same answer as
a batch run.  State is keyed by range, and each range has one timer, which reads and
removes the rows of that range only: a key with many waiting rows costs each of them once.
Every call of a processor costs some milliseconds, so the keys are dealt over buckets, and a
call handles all keys of a bucket; each key keeps a memory of its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets over which keys are dealt, and state values over which a bucket's memories are.
BUCKETS, PLACES = 256, 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedProcessor(StatefulProcessor):
    """Subclasses give ``fields`` (input columns kept), ``start`` and ``step``.

    ``step(memory, row)`` returns the next memory and an output row (or None); rows
    need ``ts`` (timestamp) and ``event_id`` for order and ties; ``at`` is ``ts`` in microseconds.
    """

    fields: list[str] = ["event_id"]
    output: str = ""

    def start(self) -> dict:
        return {}

    def step(self, memory: dict, row: dict) -> tuple[dict, dict | None]:
        raise NotImplementedError

    #: Width of a range of event time: rows come out when the watermark has passed its end.
    range_ms: int = 3_600_000
    #: Rows in one state value.
    part_rows: int = 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # part -1 of a range holds the number of its parts
        key = T.StructType([T.StructField("end", T.LongType()), T.StructField("part", T.IntegerType())])
        self.waiting = handle.getMapState("ranges", key, T.StructType([T.StructField("rows", T.StringType())]))
        place = T.StructType([T.StructField("place", T.IntegerType())])
        self.memories = handle.getMapState("memories", place, T.StructType([T.StructField("values", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ranges: dict[int, list] = {}
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
            kept = batch[[*self.key_columns, *self.fields]].astype(object).to_numpy().tolist()
            for at, row in zip(micros, kept):
                ranges.setdefault((at // 1000 // self.range_ms + 1) * self.range_ms, []).append((at, row))
        for end, arrived in ranges.items():
            head = self.waiting.getValue((end, -1))
            parts = int(head[0]) if head else 0
            for first in range(0, len(arrived), self.part_rows):
                self.waiting.updateValue((end, parts), (json.dumps(arrived[first : first + self.part_rows], default=str),))
                parts += 1
            self.waiting.updateValue((end, -1), (str(parts),))
            if not head:
                self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()  # timers of a bucket expire in order of their times
        head = self.waiting.getValue((end, -1))
        if not head:
            return iter([])
        keys, due = len(self.key_columns), {}
        for part in range(int(head[0])):
            for at, values in json.loads(self.waiting.getValue((end, part))[0]):
                due.setdefault(tuple(values[:keys]), []).append((at, dict(zip(self.fields, values[keys:]))))
            self.waiting.removeKey((end, part))
        self.waiting.removeKey((end, -1))
        places: dict[int, list] = {}
        for of in due:
            places.setdefault(zlib.crc32(json.dumps(of).encode()) % PLACES, []).append(of)
        out = []
        for place, held in places.items():
            stored = self.memories.getValue((place,))
            memories = json.loads(stored[0]) if stored else {}
            for of in held:
                name = json.dumps(of)
                memory = memories[name] if name in memories else self.start()
                for at, row in sorted(due[of], key=lambda r: (r[0], r[1]["event_id"])):
                    memory, emitted = self.step(memory, row | {"at": at})
                    if emitted is not None:
                        out.append(dict(zip(self.key_columns, of)) | emitted)
                memories[name] = memory
            self.memories.updateValue((place,), (json.dumps(memories),))
        names = [part.split()[0] for part in self.output.split(",")]
        return iter([pd.DataFrame(out)[names]] if out else [])

    key_columns: list[str] = []

    def close(self) -> None:
        pass


def run_ordered(stream: DataFrame, processor: OrderedProcessor, range_ms: int | None = None) -> DataFrame:
    """Apply a processor per key, of strings, with event-time order; ``stream`` has its watermark on ``ts``.

    Wide ranges cost fewer state calls for sparse keys, narrow ones give results sooner.
    """
    processor.range_ms = range_ms or processor.range_ms
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = stream.withColumn("_bucket", F.pmod(F.xxhash64(*processor.key_columns), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, processor.output, "append", "EventTime")
