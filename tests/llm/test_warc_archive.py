import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wardenlake.llm import warc_archive as W
from wardenlake.llm.common import shared_folder

BIG = "<p>" + "ä" * 999 + "</p>"
ROWS = [(1, "http://a", BIG), (9, "http://b", BIG), (5, "http://c\r\nX: y", BIG), (2, None, None), (3, "u", ""), (4, "u", "small"), (6, "u", "small"),
        (7, "u", "y" * 999), (8, "u", "y" * 999), (10, "u", "z" * 1000), (11, "u", "z" * 1000), (12, "u", "WARC-Type: revisit\r\n\r\n" * 100)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash")).withColumn("length", F.lit(1))


def test_round_trip(spark):
    path = shared_folder(spark, "warc")
    W.write_archive(pages(spark), path)
    rows = {r["page_id"]: r for r in W.read_records(spark, path).collect()}
    assert len(rows) == len(ROWS)
    refers = {1: 9, 5: 9, 10: 11}
    for page_id, _, html in ROWS:
        raw, row = (html or "").encode(), rows[page_id]
        assert row["payload_bytes"] == len(raw) and row["payload_digest"] == hashlib.sha1(raw).hexdigest() and bytes(row["payload"]) == raw
        assert row["refers_to"] == refers.get(page_id) and row["record_type"] == ("revisit" if page_id in refers else "response")
        head, _, body = bytes(row["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == (0 if page_id in refers else len(raw))
        assert body == (b"" if page_id in refers else raw) + b"\r\n\r\n" and "X" not in fields
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in ROWS})


def parse(record):
    """One record by the rules of the standard: version, named fields, an empty line, the block, two line ends."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(re.fullmatch(r"([A-Za-z-]+): (.*)", line).groups() for line in lines)
    assert version == "WARC/1.1" and len(fields) == len(lines)
    assert {"WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type"} <= set(fields)
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and re.fullmatch(r"<[a-z]+:[^<> ]+>", fields["WARC-Record-ID"])
    assert rest == rest[: int(fields["Content-Length"])] + b"\r\n\r\n"
    return fields


def test_records_follow_the_standard(spark):
    path = shared_folder(spark, "warc")
    W.write_archive(pages(spark, [*ROWS, *ROWS, (None, "n", "x")]), path)
    rows = [parse(bytes(r["record"])) for r in W.read_records(spark, path).collect()]
    ids = {f["WARC-Record-ID"]: f for f in rows}
    assert len(ids) == len(rows) == 2 * len(ROWS) + 1
    revisits = [f for f in rows if f["WARC-Type"] == "revisit"]
    assert revisits and all(f["WARC-Profile"] and ids[f["WARC-Refers-To"]]["WARC-Type"] == "response" and ids[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] for f in revisits)


def test_repeated_rows_null_keys_and_empty_table(spark):
    path = shared_folder(spark, "warc")
    W.write_archive(pages(spark, [(1, "u", BIG), (1, "u", BIG), (None, "u", BIG)]), path)
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in W.read_records(spark, path).collect()) == [(0, "response"), (1, "response"), (1, "response")]
    path = shared_folder(spark, "warc")
    W.write_archive(pages(spark, []), path)
    assert W.read_records(spark, path).count() == 0


def test_damage_is_found(spark):
    path, other = shared_folder(spark, "warc"), shared_folder(spark, "warc")
    W.write_archive(pages(spark), path)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        W.read_records(spark, other).collect()
