"""Operator 1: a content-addressed web archive.

Payload bytes are stored once per verified SHA-256 digest (the blob table); the exact header block of every record is
kept apart (the record table); joining both on the digest gives back the original WARC records, byte for byte. Both
tables are Parquet. All of it is DataFrame expressions. The pages have no HTTP headers, so a record's block is the payload
itself; a revisit's block is empty, and its header names its profile and the record that it refers to.

Cases: a null html is the empty payload; a null url leaves the target header out; a null page_id sorts last among equal
payloads and gets an identifier of its own. Rows that are equal in page_id, url and payload are kept as separate records
with a copy number; the first copy of the smallest page_id is the response. An empty table gives empty tables. Columns
other than the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table

CRLF = "\r\n"
WARC_DATE = "2026-01-01T00:00:00Z"
#: Fixed value: the standard's name for a revisit of an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(h: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: 20 bits are four digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, copy: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("null")), copy.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write blobs and records under path. Records with payloads under min_revisit_bytes bytes are all responses."""
    p = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # Equal records become one row with a count: the hot digest is pre-aggregated, and no payload is shuffled here.
    counted = p.groupBy("digest", "page_id", "url").agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.octet_length("payload")).cast("long").alias("payload_bytes"), F.first(F.sha1("payload")).alias("sha1")
    )
    rank = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("i"), F.col("url").isNull().alias("m"), F.col("url").alias("u"))
    first = counted.groupBy("digest").agg(F.min(rank).alias("first"))
    rows = counted.join(first, "digest").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    is_first = (F.col("copy") == 0) & F.col("first").eqNullSafe(rank)
    response = is_first | (F.col("payload_bytes") < min_revisit_bytes)
    refers = F.when(~response, F.col("first.i"))
    url_key = lambda u, copy: F.concat_ws("|", copy, F.coalesce(u, F.lit("\0")), "digest")
    original = _record_id(F.col("first.i"), url_key(F.col("first.u"), F.lit("0")), "record")
    sha = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    # Control characters cannot stand in a header line.
    as_target = lambda u: F.regexp_replace(u, "[\\x00-\\x20\\x7f]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: <"), _record_id(F.col("page_id"), url_key(F.col("url"), F.col("copy").cast("string")), "record"), F.lit(">")),
        F.lit(f"WARC-Date: {WARC_DATE}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), as_target(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: "), sha),
        F.when(response, F.concat(F.lit("WARC-Block-Digest: "), sha)),
        F.when(~response, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: <"), original, F.lit(">"))),
        F.when(~response & F.col("first.u").isNotNull(), F.concat(F.lit("WARC-Refers-To-Target-URI: "), as_target(F.col("first.u")))),
        F.when(~response, F.lit(f"WARC-Refers-To-Date: {WARC_DATE}")),
        F.when(response, F.lit("Content-Type: text/html; charset=utf-8")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(refers.isNotNull(), F.concat(F.lit("X-Refers-To-Page: "), refers.cast("string"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
    ]
    rows.select(F.col("digest"), F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8").alias("header")).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/records")
    # The join key has page_id and url too, so a hot digest's rows spread over all tasks; equal rows then meet without another exchange.
    key = lambda i, u: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), F.coalesce(u, F.lit("\0"))).alias("w")
    winners = first.select("digest", key(F.col("first.i"), F.col("first.u")))
    blobs = p.select("digest", key(F.col("page_id"), F.col("url")), "payload").join(winners, ["digest", "w"])
    blobs.dropDuplicates(["digest", "w"]).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/blobs")


def read_archive(spark: SparkSession, path: str, page_id_type: str = "bigint") -> DataFrame:
    """digest, header and payload of every record, with what the header says; payloads are checked against their digest.

    Headers hold page_id as text; page_id_type is the type it had."""
    blobs = spark.read.parquet(f"{path}/blobs")
    checked = blobs.select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest"))).alias("payload"),
    )
    facts = checked.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))
    head = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract("text", f"\r\n{name}: ([^\r]*)\r\n", 1)
    records = spark.read.parquet(f"{path}/records").withColumn("text", head)
    return (
        records.join(facts, "digest", "left")
        .withColumn("missing", F.when(F.col("payload_bytes").isNull(), F.raise_error(F.lit("a record's payload is missing"))))
        .select(
            F.expr(f"try_cast(nullif(regexp_extract(text, '\\r\\nX-Page-ID: ([^\\r]*)\\r\\n', 1), '') as {page_id_type})").alias("page_id"),
            "payload_bytes", "payload_digest", field("WARC-Type").alias("record_type"),
            F.expr(f"try_cast(nullif(regexp_extract(text, '\\r\\nX-Refers-To-Page: ([^\\r]*)\\r\\n', 1), '') as {page_id_type})").alias("refers_to"),
            "digest",
            F.concat(F.lit("sha1:"), F.col("payload_digest")).eqNullSafe(field("WARC-Payload-Digest")).alias("verified"),
        )
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The original WARC records as bytes: header block, payload (responses only), two line ends."""
    records, blobs = (spark.read.parquet(f"{path}/{x}") for x in ("records", "blobs"))
    is_response = F.instr(F.decode("header", "UTF-8"), "\r\nWARC-Type: response\r\n") > 0
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    return records.join(blobs, "digest").select("digest", F.concat("header", F.when(is_response, F.col("payload")).otherwise(F.lit(b"")), end).alias("record"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


QUERIES = {"op1_warc": op1_warc}

_B32 = " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT), 32), 4, '0')" for i in range(8))
SQL = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(x) AS payload_bytes, h, min(page_id) OVER (PARTITION BY x) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  translate(upper({_B32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS verified
FROM d"""
}
