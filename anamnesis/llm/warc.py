"""Operator 2, a content-addressed archive of web pages.

The archive is two tables in one folder. ``payloads`` holds each distinct payload once,
under its SHA-256; ``headers`` holds, for each record, the exact bytes of its WARC
header, the exact URL and the digest of its payload. The block of a record is the page itself, without
the headers of HTTP, which the pages don't have. Of records with equal payloads, the one with
the largest id is the response and the others revisit it. Records are put together
again by joining the two tables, after every stored payload has been hashed anew and
compared with its address. All of it is DataFrame functions.

One page may be a third of all. Equal payloads meet in a grouped aggregation that combines map-side. When
records are put together, an address with more than ``hot_records`` of them is hot: its
records are dealt over salts and its payload is copied once for each salt, while the others meet their
payloads in the buckets where these are stored. Sizes and digests are taken once for each stored payload, not for each record.

A session that writes an archive enters its payloads in the catalogue, as table ``warc_<digest of the path>``, so
that reads know the buckets; it may be dropped, and other sessions read the files. Writing needs the right to create tables.

Defined results: a null payload is an empty one; empty payloads are equal to each
other; a URL's control characters are written as %XX in the header, so it can't forge a field; repeated rows become
records of their own that share the record id, which is made of the page's; a null id never is a response unless
all ids of its payload are null; an empty table gives an empty archive; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import materialise, shared_dir

#: The alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32(hexadecimal: Column) -> Column:
    """Base32 of a digest given in hexadecimal; its bits are a multiple of 20, so there is no padding."""
    letters = F.lit(BASE32)

    def five(part: Column) -> Column:
        value = F.conv(part, 16, 10).cast("int")
        return F.concat(*(F.substring(letters, F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(hexadecimal) / 5).cast("int") - 1), lambda i: five(F.substring(hexadecimal, (i * 5 + 1).cast("int"), F.lit(5)))), "")


def printable(url: Column) -> Column:
    """A URL for a header line: control characters, which could end the line, as %XX."""
    one = lambda c: F.when(c.rlike(r"[\x00-\x1f\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(r"[\x00-\x1f\x7f]"), F.array_join(F.transform(F.split(url, ""), one), "")).otherwise(url)


def _table(path: str) -> str:
    """The name under which a session that wrote an archive knows the buckets of its payloads."""
    return f"warc_{hashlib.md5(path.encode()).hexdigest()}"


def write_archive(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Write the archive of ``pages`` and return its folder. Payloads under ``least_bytes`` are responses each."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    distinct = rows.groupBy("address").agg(F.first("payload").alias("payload"))
    buckets = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100_000)
    # bucketed as it is aggregated, so that the join of a later read needn't shuffle payloads
    distinct.write.option("compression", "zstd").option("path", f"{path}/payloads").bucketBy(buckets, "address").sortBy("address").saveAsTable(_table(path))
    light = materialise(rows.select("id", "url", "address", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1")), "page-digests")
    owners = light.where(F.col("size") >= least_bytes).groupBy("address").agg(F.max("id").alias("owner"))
    one = light.join(owners, "address", "left").withColumn("revisit", F.coalesce(F.col("owner") != F.col("id"), F.col("owner").isNotNull() & F.col("id").isNull()))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))

    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", urn("id")), F.lit(f"WARC-Date: {date}{CRLF}"),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", printable(F.col("url")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn("owner")), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))), F.lit(CRLF),
    )
    one.select("id", "url", F.encode(header, "UTF-8").alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


#: Hot addresses at most; they are broadcast with their numbers of salts.
MOST_HOT = 100_000


def _hot(headers: DataFrame, hot_records: int) -> DataFrame:
    """(address, salts) of the addresses with more records than ``hot_records`` and than a ``MOST_HOT``-th of all, so there are at most ``MOST_HOT``."""
    least = max(1, hot_records, headers.count() // MOST_HOT)
    many = headers.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return materialise(many.select("address", F.ceil(F.col("n") / least).cast("int").alias("salts")), "hot-addresses")


def _together(records: DataFrame, stored: DataFrame, hot: DataFrame) -> DataFrame:
    """Records joined with their stored payloads, those of hot addresses by salts."""
    if hot.isEmpty():
        return records.join(stored, "address")
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    cold = records.join(hot, "address", "left_anti").join(stored, "address")
    dealt = records.join(hot, "address").withColumn("salt", (F.monotonically_increasing_id() % F.col("salts")).cast("int")).drop("salts")
    copies = stored.join(hot, "address").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return cold.unionByName(dealt.join(copies.hint("merge"), ["address", "salt"]).drop("salt"))


def read_archive(spark: SparkSession, path: str, hot_records: int = 1000) -> DataFrame:
    """(id, record_type, refers_to, url, payload_bytes, payload_digest, payload, record, header_bytes): every record with its full payload.

    ``record`` is the record's exact bytes. A payload whose bytes don't hash to its address, or to its header's digest, raises an error.
    """
    payloads = spark.table(_table(path)) if spark.catalog.tableExists(_table(path)) else spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))))
    # hashed where it is stored, once for all records
    stored = payloads.select("address", sound.alias("payload"), base32(F.sha1("payload")).alias("found"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    text = F.col("header").cast("string")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"(?:^|\n){name}: {value}\r\n", 1), F.lit(""))
    headers = spark.read.parquet(f"{path}/headers")
    records = headers.select(
        "id", "url", "header", "address", field("WARC-Type", "(.*)").alias("record_type"), field("WARC-Refers-To", "<urn:page:(.*)>").alias("refers"), field("WARC-Payload-Digest", "sha1:(.*)").alias("told"))
    digest = F.when(F.col("told") == F.col("found"), F.col("found")).otherwise(F.raise_error(F.lit("a header's digest isn't its payload's")))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    record = F.concat("header", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")), end)
    kind = records.schema["id"].dataType
    return _together(records, stored, _hot(headers, hot_records)).select(
        "id", "record_type", F.col("refers").cast(kind).alias("refers_to"), "url", "payload_bytes", digest.alias("payload_digest"), "payload", record.alias("record"), F.length("header").alias("header_bytes"))


def blocks(records: DataFrame) -> DataFrame:
    """Records with their ``block``: what a record's bytes hold between its header and its end."""
    size = F.octet_length("record") - F.col("header_bytes") - len(CRLF * 2)
    return records.withColumn("block", F.substring(F.col("record"), F.col("header_bytes") + 1, size))
