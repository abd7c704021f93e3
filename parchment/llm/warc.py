"""A content-addressed WARC archive: payloads once by their strong digest, record headers apart, records by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Records with payloads from this size on refer to an equal one instead of repeating it.
REVISIT_BYTES = 1000
_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """payloads: digest (SHA-256), payload, one row each. headers: record_id, url (both exactly as given), header (the
    record's bytes before its payload), digest; one row a record."""

    payloads: DataFrame
    headers: DataFrame


def _line(name: str, value: Column) -> Column:
    """A header line; null values leave it out. Line breaks within a value are percent-encoded, as they would end it."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_EOL)), F.lit(""))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> Archive:
    """A record per row. Of equal payloads of at least revisit_bytes, the row with the largest id is the response and
    the others are revisits of it; smaller ones are responses all. Null payloads are empty, null ids and urls leave
    their header lines out, rows that repeat an id are records of their own (equal ids and payloads: all are
    responses). Other columns are ignored; an empty table gives an empty archive.

    Payload bytes move once per distinct payload and map task: copies are combined before the shuffle.
    """
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    store = rows.groupBy("digest").agg(F.any_value("payload").alias("payload"), F.min(F.sha1("payload")).alias("a"), F.max(F.sha1("payload")).alias("b"))
    # a second digest verifies that one strong digest stands for one payload
    store = store.where(F.assert_true(F.col("a") == F.col("b"), "payloads differ under one digest").isNull()).select("digest", "payload")
    heads = materialize(rows.select("record_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-rows")
    kept = heads.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("record_id").alias("kept"))
    of = heads.join(kept, "digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit("<urn:parchment:record:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("record_id"))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("kept")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
        F.lit(_EOL),
    )
    return Archive(materialize(store, "warc-payloads", compression="zstd"), materialize(of.select("record_id", "url", header.alias("header"), "digest"), "warc-headers"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(archive: Archive) -> DataFrame:
    """The records again: record_id, record_type, url, refers_to, payload (the full one, of revisits too), payload_bytes,
    payload_digest (SHA-1 of the stored bytes) and record, the bytes of the WARC record. Stored payloads are verified
    against their digest, and the headers against the payload."""
    stored = archive.payloads.where(F.assert_true(F.sha2("payload", 256) == F.col("digest"), "a stored payload does not have its digest").isNull())
    stored = stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    kind, target = _field("WARC-Type"), F.nullif(_field("WARC-Refers-To"), F.lit(""))
    heads = archive.headers.select(
        "record_id", "url", "header", "digest", kind.alias("record_type"), F.regexp_extract(target, r"record:(-?\d+)>", 1).alias("to"),
        _field("WARC-Payload-Digest").alias("said"), F.regexp_extract(_field("WARC-Record-ID"), r"record:(-?\d+)>", 1).alias("own"),
    )
    both = heads.join(stored, "digest").where(F.assert_true(F.col("said") == F.concat(F.lit("sha1:"), "payload_digest"), "a record's digest is not its payload's").isNull())
    both = both.where(F.assert_true(F.col("own") == F.coalesce(F.col("record_id").cast("string"), F.lit("")), "a record's header names another record").isNull())
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "utf-8"), body, F.lit(b"\r\n\r\n"))
    return both.select("record_id", "record_type", "url", F.nullif("to", F.lit("")).cast("long").alias("refers_to"), "payload", "payload_bytes", "payload_digest", record.alias("record"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(archive).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p
), k AS (
  SELECT digest, max(page_id) AS kept FROM d WHERE n >= 1000 GROUP BY digest
)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.kept IS NOT NULL AND k.kept <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.kept IS NOT NULL AND k.kept <> d.page_id THEN k.kept END AS refers_to
FROM d LEFT JOIN k USING (digest)
"""
