import io
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, table
from tests.llm.test_bpe_codec import WORD, library
from wardenlake.llm import token_store as S
from wardenlake.llm.common import shared_folder


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def small_file(docs):
    out = io.BytesIO()
    writer = S.TokenFileWriter(out)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    return out.getvalue()


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(S, "FRAME_BYTES", 64)
    docs = [(5, range(3)), (None, []), (7, range(100)), (8, range(50)), (9, [1])]
    raw = small_file(docs)
    reader = S.TokenFileReader(Source(raw))
    assert reader.ids == [5, None, 7, 8, 9]
    for place in (4, 0, 2, 1, 3):
        assert np.frombuffer(reader.tokens(place), "<u4").tolist() == list(docs[place][1])
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == [i for _, ids in docs for i in ids]
    assert S.TokenFileReader(Source(small_file([]))).ids == []


def test_only_wanted_frames_are_read_and_damage_is_found(monkeypatch):
    monkeypatch.setattr(S, "FRAME_BYTES", 64)
    raw = bytearray(small_file([(i, range(16)) for i in range(20)]))
    reader = S.TokenFileReader(Source(bytes(raw)))
    asked = []
    frame = reader.frame
    monkeypatch.setattr(reader, "frame", lambda k: asked.append(k) or frame(k))
    reader.tokens(7)
    assert set(asked) == {7}
    raw[int(reader.packed[3]) + 9] ^= 1
    broken = S.TokenFileReader(Source(bytes(raw)))
    assert len(broken.tokens(2)) == 64
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.tokens(3)


def test_write_and_read(spark):
    texts = [*ODD, *(f"text number {i}" for i in range(200))]
    docs = table(spark, texts, extra=True).unionByName(table(spark, ["no key"], extra=True).withColumn("doc_id", F.lit(None).cast("long")))
    folder = shared_folder(spark, "tokens")
    manifest = S.write_tokens(docs, folder, WORD)
    own = library(WORD)
    want, at = {}, len(own.encode("no key", add_special_tokens=False).ids) + 1
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, S.END_ID]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in S.read_tokens(manifest, folder).collect()}
    assert got.pop(None)[0] == 0 and got == want
    few = {r["doc_id"]: r["start"] for r in S.read_tokens(manifest, folder, [3, 150, 9999]).collect()}
    assert few == {i: want[i][0] for i in (3, 150)}
    assert [r["start"] for r in S.read_tokens(manifest, folder, [None]).collect()] == [0]
    assert S.read_tokens(manifest, folder, []).count() == 0
    none = S.write_tokens(table(spark, []), folder, WORD)
    assert S.read_tokens(none, folder).count() == 0


def test_only_files_that_may_hold_a_wanted_key_are_opened(spark):
    docs = table(spark, [f"text number {i}" for i in range(400)]).withColumn("path", F.lit("clash"))
    folder = shared_folder(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges for few rows
    try:
        manifest = S.write_tokens(docs, folder, WORD)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = sorted(manifest.collect(), key=lambda r: r["first_key"])
    assert len(rows) > 1 and all(a["last_key"] < b["first_key"] for a, b in zip(rows, rows[1:]))
    unopened = manifest.withColumn("path", F.when(F.col("file_no") == rows[1]["file_no"], F.col("path")).otherwise("absent.tokens"))
    wanted = [rows[1]["first_key"], rows[1]["last_key"], -5, 10_000]
    assert {r["doc_id"] for r in S.read_tokens(unopened, folder, wanted).collect()} == set(wanted[:2])


def test_may_hold():
    for wanted in ([], [None], [3], [1, 9], [1, 9, None]):
        for first, last in ((None, None), (None, 3), (3, 3), (2, 8), (0, 20)):
            keys = {None} if first is None else set()
            keys |= set(range(-5 if first is None else first, last + 1)) if last is not None else set()
            assert S.may_hold(wanted, first, last) == bool(keys & set(wanted))
