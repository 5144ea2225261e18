"""Content-addressed WARC archive: payload bytes once by digest, record headers apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the record format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32, upper case, of 20 bytes in hex: 40 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Control characters of a value, which would break the line, are percent-encoded."""
    controls = [*range(32), 127]
    safe = reduce(lambda v, c: F.replace(v, F.lit(chr(c)), F.lit(f"%{c:02X}")), controls, value)
    value = F.when(value.rlike(r"[\x00-\x1F\x7F]"), safe).otherwise(value)
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write one WARC record for each row: exact header bytes to ``path/headers``, each payload once to ``path/payloads``.

    The payload is the html in UTF-8 (null: empty). Of the records with one payload the
    one with the largest id is a response, the others revisit it; rows that repeat that
    id are responses too. A null id is smaller than all others. The store is keyed by
    SHA-256; a key under which SHA-1 or length differ stops the job. An empty table
    gives an empty archive; other columns are not read.

    Payloads cross one shuffle, and equal ones of a task are one row there, so a payload
    that a third of all pages share is no hot task. Then only ids, urls and digests meet in a join
    on digests, whose left side may be split. Digests are binary.
    """
    body = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    p = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    sha256, sha1 = F.unhex(F.sha2("payload", 256)), F.unhex(F.sha1("payload"))
    digests = p.select("page_id", "url", "payload", sha256.alias("key"), sha1.alias("sha1"), F.octet_length("payload").alias("octets"))
    one = F.assert_true(
        (F.min("sha1") == F.max("sha1")) & (F.min("octets") == F.max("octets")), F.lit("two payloads have one SHA-256")
    )
    folded = digests.groupBy("key").agg(F.max("page_id").alias("holder"), F.first("payload").alias("payload"), one.alias("checked"))
    folded.where("checked IS NULL").select(F.col("key").alias("payload_key"), "holder", "payload").write.parquet(f"{path}/payloads")

    kind = pages.schema[page_id].dataType.simpleString()
    stored = pages.sparkSession.read.schema(f"payload_key binary, holder {kind}").parquet(f"{path}/payloads")
    slim, holders = digests.drop("payload"), stored.withColumnRenamed("payload_key", "key")

    known = slim.join(holders, "key", "left")
    is_response = F.col("page_id").eqNullSafe(F.col("holder"))
    urn = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), c.cast("string"), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("octets").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.octet_length(http) + F.when(is_response, F.col("octets")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.hex("sha1")))),
        F.when(
            ~is_response, F.concat(_line("WARC-Profile", F.lit(REVISIT_PROFILE)), _line("WARC-Refers-To", urn(F.col("holder"))))
        ).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    known.select(F.col("key").alias("payload_key"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive, put together again.

    header (exact bytes up to the payload), record (the record to the end of its block: a
    response with its payload, a revisit without), closed_record (with the two line ends that
    close it, so that records one after another are a WARC file), payload (in full, also for a revisit),
    payload_bytes and payload_sha1 (hex, both computed from the stored bytes), and the
    fields record_type, record_id, target_uri, payload_digest, refers_to of the header
    (null where it has none). A payload whose SHA-256 isn't its key stops the job, and
    so does a header without its payload.
    """
    good = F.unhex(F.sha2("payload", 256)) == F.col("payload_key")
    stored = spark.read.schema("payload_key binary, payload binary").parquet(f"{path}/payloads").select(
        "payload_key",
        "payload",
        F.when(good, F.octet_length("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("payload_key")))).alias("payload_bytes"),
        F.sha1("payload").alias("payload_sha1"),
    )
    headers = spark.read.schema("payload_key binary, header binary").parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    urn = lambda c: F.regexp_extract(c, rf"^<{RECORD_URN}(.*)>$", 1)
    joined = headers.join(stored, "payload_key", "left")
    kind = field("WARC-Type")
    record = F.concat(F.col("header"), F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")))
    found = F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload is missing")))
    return joined.select(
        "header",
        record.alias("record"),
        F.concat(record, F.lit(b"\r\n\r\n")).alias("closed_record"),
        "payload",
        found.alias("payload_bytes"),
        "payload_sha1",
        kind.alias("record_type"),
        urn(field("WARC-Record-ID")).alias("record_id"),
        field("WARC-Target-URI").alias("target_uri"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        urn(field("WARC-Refers-To")).alias("refers_to"),
    )
