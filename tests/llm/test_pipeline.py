"""The pipeline, stage by stage, against plain-Python versions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_bpe_codec import BYTE, library
from tests.llm.test_hyperminhash import brute
from tests.llm.test_packing import gapless
from wardenlake.llm import language_id, quality
from wardenlake.llm.common import arrow_bytes, fold

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
        docs = out[-1]
    return out


def test_quality_stage(spark, stages):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    want = {r["doc_id"] for r in docs.collect() if model.scores(*arrow_bytes(pa.array([r["text"]])))[0] >= 0.3}
    assert stages[0].columns == C.DOCUMENT == docs.columns and {r["doc_id"] for r in stages[0].collect()} == want and 0 < len(want) < docs.count()


def test_language_stage(stages):
    model = language_id.train(stages[0], fold(F.col("doc_id"), 3) != 1)
    want = set()
    for r in stages[0].collect():
        raw = r["text"].encode()
        bits = model.code_lengths(*arrow_bytes(pa.array([r["text"]])))[0].min() / language_id.UNIT
        if any(c.isalpha() for c in r["text"]) and bits < 8 * len(raw):
            want.add(r["doc_id"])
    assert stages[1].columns == C.DOCUMENT and {r["doc_id"] for r in stages[1].collect()} == want


def test_near_copies_stage(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    want = {rows[i][0] for i, _, _, kept in brute([t for _, t in rows], 5, 80) if kept}
    assert stages[2].columns == C.DOCUMENT and {r["doc_id"] for r in stages[2].collect()} == want


def test_near_copies_of_repeated_and_missing_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other, third = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(5, words), (3, other), (3, words + " end"), (3, third), (3, third), (None, third + " end"), (None, "alone in the world with this"), (None, "alone in the world with this"), (7, None), (8, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = C.keep_distinct(spark, docs, SF_DIR)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert kept.columns == C.DOCUMENT
    assert got == sorted([(3, other), (3, words + " end"), (3, third), (0, "alone in the world with this"), (7, ""), (8, "")])
    assert C.keep_distinct(spark, docs.limit(0), SF_DIR).count() == 0


def test_packing_stage_and_run(spark, stages):
    own = library(BYTE)
    want = {r["doc_id"]: len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[2].collect()}
    rows = stages[3].collect()
    sizes = {}
    for r in rows:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == want
    gapless((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, C.run(spark, SF_DIR).select(pieces).collect())) == sorted(map(tuple, stages[3].select(pieces).collect()))


def test_names():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "language id", "MinHash near-dedup", "best-fit packing"]
