"""Content-addressed WARC archive.

Two Parquet tables hold an archive: ``payloads`` has the bytes of each distinct payload once, under
their SHA-256 digest and length, and ``headers`` has one row a record with its exact header block.
A record is header block, payload and two line ends; a revisit record has a header block only and
names the record that holds the payload.  Reading joins the tables and checks every digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.llm.common import through_table

REVISIT_FROM = 1000
_PREFIX = "urn:warden:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _block(fields: list[tuple[str, Column]]) -> Column:
    """A header block; fields without a value are left out.  Line ends inside values become spaces."""
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " ")) for name, value in fields]
    return F.concat_ws(_END, F.lit("WARC/1.1"), *lines, F.lit(""), F.lit(""))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", revisit_from: int = REVISIT_FROM, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record a row below ``path``.

    The payload is the body in UTF-8, null bodies are empty.  Of records with equal payloads of at
    least ``revisit_from`` bytes that with the largest key is a response and the others revisit it;
    smaller payloads are always responses.  Rows with a null key are responses of their own, and so
    are all rows that repeat the largest key.  Other columns are not archived.
    """
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    named = through_table(rows.select("page_id", "url", "digest", "length", F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("row")), "page-digests")
    holders = named.groupBy("digest", "length").agg(F.max(F.struct("page_id", "row")).alias("holder"), F.count(F.lit(1)).alias("n"))
    several = holders.where((F.col("n") > 1) & (F.col("length") >= revisit_from)).select("digest", "holder")
    placed = named.join(several, "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("holder.page_id"), F.lit(False))

    def record(page: str, row: str) -> Column:  # the row number of the written table tells repeated keys apart
        return F.concat(F.lit(f"<{_PREFIX}"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))

    shared = [("WARC-Record-ID", record("page_id", "row")), ("WARC-Date", F.lit(date)),
              ("WARC-Target-URI", F.col("url")),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
              ("WARC-Identified-Payload-Length", F.col("length").cast("string")), ("Content-Type", F.lit("text/html"))]
    response = _block([("WARC-Type", F.lit("response")), *shared, ("Content-Length", F.col("length").cast("string"))])
    again = _block([("WARC-Type", F.lit("revisit")), *shared, ("WARC-Profile", F.lit(_PROFILE)),
                    ("WARC-Refers-To", record("holder.page_id", "holder.row")), ("Content-Length", F.lit("0"))])
    headers = placed.select("page_id", "digest", F.when(revisit, again).otherwise(response).cast("binary").alias("header"))
    headers.write.parquet(f"{path}/headers")
    # each digest's bytes come from the row with its smallest key; a payload moves once, by a key that no group shares
    at = F.coalesce("page_id", F.lit(-1)).alias("at")
    owner = named.select("digest", at).groupBy("digest").agg(F.min("at").alias("at"))
    kept = rows.select("digest", at, "length", "payload").join(owner, ["digest", "at"], "left_semi")
    kept.dropDuplicates(["digest", "at"]).select("digest", "length", "payload").write.parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)$", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, record_type, refers_to, payload_digest, payload_bytes, header, payload, record.

    ``payload`` is the full payload, for revisits as well; ``record`` holds the record's exact bytes.
    A stored payload whose digest or length differs from its address, and a header without payload,
    end the read with an error.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads").withColumn("checked", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    fits = (F.col("checked") == F.col("digest")) & (F.col("size") == F.col("length"))
    stored = stored.select("digest", F.when(fits, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("sha1"), "size", "payload")
    parsed = headers.select("page_id", "digest", "header", _field("WARC-Type").alias("record_type"),
                            F.regexp_extract(_field("WARC-Refers-To"), rf"^<{_PREFIX}(.*):[0-9]+>$", 1).cast("long").alias("refers_to"),
                            F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("stated"))
    joined = parsed.join(stored, "digest", "left")
    digest = F.when(F.col("sha1") == F.col("stated"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("no payload for "), F.col("digest"))))
    own = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", "record_type", "refers_to", digest.alias("payload_digest"), F.col("size").alias("payload_bytes"), "header", "payload",
                         F.concat("header", own, F.lit(b"\r\n\r\n")).alias("record"))
