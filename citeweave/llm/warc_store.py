"""WARC: a content-addressed archive of records.

``write_archive`` keeps two tables in a folder: ``payloads``, the bytes of each distinct
payload once, under its SHA-256, and ``headers``, the exact header bytes of every record with
the digest of its payload. Of the records with equal payloads that with the smallest page_id
is the ``response``; the others are ``revisit`` records that refer to it. The digest is
verified twice: before records are taken for equal their length, SHA-1 and a third hash must
agree too, and the reader computes the digests anew from the stored bytes.

``reconstruct`` joins the two tables into the bytes of the original WARC records; ``parse``
takes such bytes apart, and ``records`` reads every field and digest from them alone. All of it is DataFrame expressions. A popular payload is a hot key
only in an aggregation with partial sums and in a plain equi-join, whose skewed partitions
Spark splits; payload bytes are never grouped.

Null html counts as empty. Payloads of fewer than ``min_bytes`` bytes are all responses.
Rows that repeat the smallest page_id of a payload are each written as a response (the same
record again). A null page_id sorts after all others; a null url has no target line, and
control characters in a url are percent-encoded in the header. An empty table gives an empty
archive. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import materialize

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a 40-digit hex string (20 bytes: four groups of 5)."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digests(payload: Column) -> list[Column]:
    return [F.sha2(payload, 256).alias("digest"), base32(F.upper(F.sha1(payload))).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes")]


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _safe(url: Column) -> Column:
    for c in range(32):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return url


def _header(date: str) -> Column:
    """Header bytes as text, up to and with the blank line; the HTTP head is part of a record's block."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HTTP_HEAD), F.lit("Content-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page: "), F.col("first_id").cast("string"))),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http)


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    spark = pages.sparkSession
    records = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    marked = records.select("page_id", "url", *digests(F.col("payload")), F.xxhash64("payload").alias("check"))
    marked = materialize(marked, "warc-digests")
    first = marked.groupBy("digest").agg(
        F.min("page_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        ((F.min("sha1") == F.max("sha1")) & (F.min("n_bytes") == F.max("n_bytes")) & (F.min("check") == F.max("check"))).alias("verified"),
    )
    # Only payloads that occur more than once need an answer from elsewhere.
    first = materialize(first.where((F.col("copies") > 1) | ~F.col("verified")), "warc-first")
    if first.where(~F.col("verified")).limit(1).count():
        raise ValueError("two payloads share a SHA-256 digest")
    typed = marked.join(first.select("digest", "first_id"), "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= min_bytes)
    typed = typed.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    typed.select("page_id", "digest", "record_type", F.encode(_header(date), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")

    # A payload is stored by its first record; for payloads below min_bytes one record stands for all.
    later = marked.join(first.select("digest", "first_id"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "digest").distinct()
    repeated = materialize(marked.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id", "digest"), "warc-repeated")
    all_bytes = records.select("page_id", F.sha2("payload", 256).alias("digest"), "payload")

    def same(rows: DataFrame, keys: DataFrame) -> Column:
        return rows["page_id"].eqNullSafe(keys["page_id"]) & (rows["digest"] == keys["digest"])

    some = repeated.limit(1).count() > 0
    not_here = later.unionByName(repeated).distinct() if some else later
    stored = all_bytes.join(not_here, same(all_bytes, not_here), "left_anti").select("digest", "payload")
    if some:  # of rows that repeat the page that stores a payload, one does; no other payload moves for it
        first_ids = repeated.join(later, repeated["page_id"].eqNullSafe(later["page_id"]) & (repeated["digest"] == later["digest"]), "left_anti")
        stored = stored.unionByName(all_bytes.join(first_ids, same(all_bytes, first_ids), "left_semi").select("digest", "payload").dropDuplicates(["digest"]))
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record binary: the original records, each header joined with its payload by digest.

    A revisit's block holds no payload, so revisits, however many, do not meet the stored bytes.
    """
    headers, payloads = read_archive(spark, folder)
    end = F.lit(b"\r\n\r\n")
    whole = headers.where("record_type = 'response'").join(payloads, "digest").select("page_id", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(headers.where("record_type <> 'response'").select("page_id", F.concat("header", end).alias("record")))


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(header.rlike(rf"(?md)^{name}: "), found)


#: Bytes of a record that hold its two heads; a longer URL makes a record be searched whole.
HEAD_BYTES = 1 << 14


def parse(record: Column) -> dict[str, Column]:
    """Columns with the fields and the payload of record bytes; ``whole`` tells that the block has the length that its header states."""
    first = F.decode(F.substring(record, 1, HEAD_BYTES), "ISO-8859-1")
    two_heads = F.size(F.split(first, "\r\n\r\n", 3)) > 2
    text = F.when(two_heads, first).otherwise(F.decode(record, "ISO-8859-1"))
    head = F.substring_index(text, "\r\n\r\n", 1)
    heads = F.substring_index(text, "\r\n\r\n", 2)
    block = F.octet_length(record) - F.length(head) - 8
    return {
        "record_type": _field(head, "WARC-Type"),
        "record_id": _field(head, "WARC-Record-ID"),
        "payload_digest": _field(head, "WARC-Payload-Digest"),
        "refers_to": F.decode(F.encode(_field(head, "WARC-Refers-To-Page"), "ISO-8859-1"), "UTF-8"),
        "payload": F.substring(record, F.length(heads) + 5, F.octet_length(record) - F.length(heads) - 8),
        "whole": (block.cast("string") == _field(head, "Content-Length")) & (F.substring(record, -4, 4) == F.lit(b"\r\n\r\n")),
    }


def records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the bytes of the reconstructed records.

    A response's digests are computed anew from the payload in its record, which must be what
    its header states; a revisit has those of the response that it refers to.
    """
    made = reconstruct(spark, folder)
    fields = parse(F.col("record"))
    read = made.select("page_id", *(c.alias(n) for n, c in fields.items()))
    sha1 = base32(F.upper(F.sha1("payload")))
    response = F.col("record_type") == "response"
    damaged = F.raise_error(F.lit("a record's bytes do not match its header"))
    fits = F.col("whole") & (~response | (F.concat(F.lit("sha1:"), F.col("computed")) == F.col("payload_digest")))
    read = read.select("page_id", "record_type", "refers_to", "whole", "payload_digest", sha1.alias("computed"), F.octet_length("payload").cast("long").alias("n_bytes"))
    read = read.select("page_id", "record_type", "refers_to", F.when(fits, F.substring("payload_digest", 6, 32)).otherwise(damaged).alias("payload_digest"), "n_bytes")
    read = materialize(read, "warc-read")  # without payloads
    responses = read.where("record_type = 'response'").select("page_id", "n_bytes", "payload_digest", "record_type", "refers_to")
    revisits = read.where("record_type <> 'response'")
    known = responses.select(F.col("page_id").cast("string").alias("refers_to"), "payload_digest", F.col("n_bytes").alias("first_bytes")).distinct()
    n_bytes = F.when(F.col("first_bytes").isNotNull(), F.col("first_bytes")).otherwise(F.raise_error(F.lit("a revisit refers to no response with its payload")))
    again = revisits.drop("n_bytes").join(known, ["refers_to", "payload_digest"], "left").select("page_id", n_bytes.alias("n_bytes"), "payload_digest", "record_type", "refers_to")
    found = responses.unionByName(again)
    return found.select("page_id", F.col("n_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
