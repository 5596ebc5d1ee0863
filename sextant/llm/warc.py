"""A content-addressed WARC archive: payloads once, headers apart, joined back.

Writing gives two tables. ``payloads`` holds each distinct payload once, keyed by
its SHA-256; ``headers`` holds the exact header block of every record with the
digest of its payload. Of records that share a payload of at least ``MIN_REVISIT``
bytes, the one with the largest page_id is a response and the others are revisits
that refer to it; shorter payloads give responses only.

Reading verifies every stored payload against its digest and length, joins
headers to payloads and rebuilds the records byte for byte; a mismatch fails the
job. Everything a reader learns comes from the rebuilt header lines and bytes.

``write_warc`` writes the records as WARC files and ``read_warc`` reads such files.

Null html counts as empty, null url gives an empty target. Rows that repeat a
page_id are separate records. Winners are found on digests alone, with partial
aggregation; where records meet their winner or payload, a payload shared by many
of them is split over tasks. Only page_id, url and html are read; an empty table
gives an empty archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import joined, stored

#: Payloads shorter than this are never replaced by a revisit.
MIN_REVISIT = 1000
CRLF = "\r\n"
#: The capture date where the caller gives none; pages carry no date.
DATE = "1970-01-01T00:00:00Z"
#: Records of a WARC file, which is read whole.
FILE_RECORDS = 10_000
#: Fixed value: the profile of revisits with an identical payload (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        payload.alias("payload"),
    )


def _facts(pages: DataFrame) -> DataFrame:
    """Identity, digests and length of each record, without its payload."""
    return _payload(pages).select(
        "page_id",
        "url",
        F.sha2("payload", 256).alias("sha256"),
        F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(kind: Column, refers_to: Column, date: str) -> Column:
    revisit = kind == F.lit("revisit")
    block_bytes = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    safe_url = F.regexp_replace("url", r"[\r\n]+", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(line("WARC-Refers-To", _record_id(refers_to)), line("WARC-Profile", F.lit(PROFILE))),
        ).otherwise(F.lit("")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both stored in the shared folder."""
    facts = stored(_facts(pages), "warc-facts")
    best = facts.groupBy("sha256").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n_records"))
    marked = joined(facts, stored(best, "warc-winners"), "sha256", "n_records")
    refers = (F.col("payload_bytes") >= F.lit(MIN_REVISIT)) & (F.col("page_id") < F.col("winner"))
    kind = F.when(refers, F.lit("revisit")).otherwise(F.lit("response"))
    headers = stored(
        marked.select("sha256", _header(kind, F.col("winner"), date).alias("header")), "warc-headers"
    )
    # equal digests stand for equal bytes, so any record's copy will do; reading verifies it
    held = _payload(pages).select(F.sha2("payload", 256).alias("sha256"), "payload")
    once = held.groupBy("sha256").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n_records"))
    payloads = stored(once, "warc-payloads")
    return headers, payloads


def verified(payloads: DataFrame) -> DataFrame:
    """The payloads, each checked against its digest; a mismatch fails the job."""
    sound = F.sha2("payload", 256) == F.col("sha256")
    checked = F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))).cast("binary")
    )
    return payloads.select("sha256", checked.alias("payload"), "n_records")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)\r\n", 1)


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each record rebuilt: header, record bytes, and the payload that it stands for.

    ``record`` is the whole record as it would lie in a WARC file: a revisit has
    an empty block, a response its payload.
    """
    whole = joined(headers, verified(payloads), "sha256", "n_records")
    revisit = _field("WARC-Type") == F.lit("revisit")
    end = F.lit(CRLF * 2).cast("binary")
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return whole.select(
        "header",
        F.concat(F.encode("header", "UTF-8"), block, end).alias("record"),
        "payload",
    )


def archive_report(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    Lengths and digests are those of the bytes read back, taken from the record
    itself for a response; they must agree with the header, or the job fails.
    """
    page = lambda name: F.regexp_extract("header", rf"(?m)^{name}: <urn:page:(-?\d+)>\r\n", 1)
    records = read_archive(headers, payloads).select(
        F.nullif(page("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.nullif(page("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        F.regexp_extract("header", r"(?m)^WARC-Payload-Digest: sha1:([0-9a-f]*)\r\n", 1).alias("said_digest"),
        _field("WARC-Payload-Length").cast("long").alias("said_bytes"),
        _field("Content-Length").cast("long").alias("block_bytes"),
        (F.octet_length("record") - F.octet_length("header") - F.lit(4)).cast("long").alias("in_record"),
    )
    sound = (
        (F.col("said_digest") == F.col("payload_digest"))
        & (F.col("said_bytes") == F.col("payload_bytes"))
        & (F.col("block_bytes") == F.col("in_record"))
    )
    failed = F.raise_error(F.lit("a record does not match its header")).cast("string")
    return records.select(
        "page_id",
        "payload_bytes",
        F.when(sound, F.col("payload_digest")).otherwise(failed).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def write_warc(headers: DataFrame, payloads: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write the records to WARC files of at most ``file_records`` records each.

    A record is its header, its block and two line ends; the last are what Spark's
    text writer puts behind each row.
    """
    records = read_archive(headers, payloads)
    block = F.when(_field("WARC-Type") == F.lit("revisit"), F.lit("")).otherwise(F.col("payload").cast("string"))
    lines = records.select(F.concat("header", block).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", file_records).text(path)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for name, content in zip(pdf["path"], pdf["content"]):
            rows, at = [], 0
            while at < len(content):
                end = content.index(b"\r\n\r\n", at) + 4
                header = content[at:end].decode()
                fields = dict(line.split(": ", 1) for line in header.split(CRLF)[1:] if line)
                size = int(fields["Content-Length"])
                if content[end + size : end + size + 4] != b"\r\n\r\n":
                    raise ValueError(f"a record of {name} does not end where its length says")
                rows.append((header, content[end : end + size]))
                at = end + size + 4
            yield pd.DataFrame(rows, columns=["header", "block"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and block of each record of the WARC files in a folder."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_parse, "header string, block binary")
