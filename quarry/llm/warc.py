"""Content-addressed WARC archive.

``write_archive`` writes two tables into a shared folder:

* ``headers``: one row per page with the exact record header (WARC/1.1), the exact
  HTTP header of the block, and the digest of the payload;
* ``payloads``: every distinct payload once, under its SHA-256.

Of the records with equal payloads of at least ``MIN_SHARED`` bytes the one with
the smallest page_id is the response and the others revisit it; smaller payloads
are stored once as well, but all their records are responses. ``read_archive``
parses the headers, recomputes length and digest of every stored payload and joins
the two by digest; ``records`` rebuilds the original record bytes by the same join.

Only narrow rows (ids and digests) meet by digest on the page side; the join by
digest can be split by adaptive execution where one digest is hot, and a payload
crosses the network once, after duplicates of the same task were combined.

Defined results: null html counts as empty; a null url gives no target line; line
breaks in a url are percent-encoded; repeated rows are kept, and rows that share
the smallest page_id of a payload are all responses; null page_ids come last when
the first is chosen; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Payloads below this size never become revisits.
MIN_SHARED = 100
#: The pages carry no date; records are dated by this parameter.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
URN = "urn:page:"


def _line(name: str, value) -> F.Column:
    """``Name: value`` and a line end; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _field(header: str, name: str) -> F.Column:
    """Value of a header line, null where there is none."""
    found = F.regexp_extract(header, rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, folder: str, min_shared: int = MIN_SHARED, date: str = DATE) -> str:
    """Archive ``pages(page_id, url, html)`` below ``folder``; returns the folder."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))

    # Every distinct payload once. Two payloads of one digest must agree in a second hash.
    kept = rows.select("digest", "bytes", "payload", F.xxhash64("payload").alias("check")).groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("check").alias("low"), F.max("check").alias("high"),
        F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    same = (F.col("low") == F.col("high")) & (F.col("least") == F.col("most"))
    kept = kept.select("digest", F.when(same, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("different payloads share the digest "), "digest"))).alias("payload"))
    kept.write.option("compression", "zstd").parquet(f"{folder}/payloads")

    narrow = rows.drop("payload")
    firsts = narrow.filter(F.col("bytes") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("first"))
    typed = narrow.join(firsts, "digest", "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(EOL * 2))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    typed = typed.select("page_id", "digest", "bytes", url.alias("url"), http.alias("http_header"),
                         F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("type"),
                         F.when(is_revisit, F.col("first").cast("string")).alias("first"))
    block = F.octet_length("http_header") + F.when(F.col("type") == "response", F.col("bytes")).otherwise(F.lit(0))
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"), _line("WARC-Type", F.col("type")),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), F.col("first"), F.lit(">"))),
        _line("WARC-Profile", F.when(F.col("type") == "revisit", F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(EOL))
    typed.select(header.alias("header"), "http_header", "digest").write.option("compression", "zstd").parquet(f"{folder}/headers")
    return folder


def _parsed(spark, folder: str) -> DataFrame:
    """Headers with their fields; the digest is what the header says."""
    headers = spark.read.schema("header string, http_header string, digest string").parquet(f"{folder}/headers")
    number = rf"^<{URN}(.*)>$"
    return headers.select(
        F.regexp_extract(_field("header", "WARC-Record-ID"), number, 1).try_cast("long").alias("page_id"),
        _field("header", "WARC-Target-URI").alias("url"), _field("header", "WARC-Type").alias("record_type"),
        F.regexp_extract(_field("header", "WARC-Refers-To"), number, 1).cast("long").alias("refers_to"),
        F.regexp_extract(_field("header", "WARC-Payload-Digest"), "^sha256:([0-9a-f]+)$", 1).alias("payload_digest"),
        F.regexp_extract("http_header", r"Content-Length: (\d+)", 1).cast("long").alias("said_bytes"),
        "header", "http_header")


def _payloads(spark, folder: str) -> DataFrame:
    """Stored payloads, measured again: digest and length are those of the bytes."""
    return spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").select(
        F.col("digest").alias("stored_digest"), "payload", F.sha2("payload", 256).alias("found_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))


def read_archive(spark, folder: str) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_digest,
    payload_bytes, payload. Length and digest are recomputed from the stored bytes
    and held against the headers. A reader that leaves ``payload`` out moves
    only narrow rows: the bytes are digested where they lie."""
    joined = _parsed(spark, folder).join(_payloads(spark, folder), F.col("payload_digest") == F.col("stored_digest"), "left")
    sound = (F.col("found_digest") == F.col("payload_digest")) & (F.col("payload_bytes") == F.col("said_bytes"))
    checked = F.when(sound, F.col("found_digest")).otherwise(F.raise_error(F.concat(
        F.lit("payload is missing or damaged: "), "payload_digest")))
    return joined.select("page_id", "url", "record_type", "refers_to", checked.alias("payload_digest"),
                         "payload_bytes", "payload")


def records(spark, folder: str) -> DataFrame:
    """(page_id, record): the exact bytes of every WARC record. A revisit has no
    payload of its own; everything else is header, HTTP header, payload, two line ends."""
    joined = _parsed(spark, folder).join(_payloads(spark, folder), F.col("payload_digest") == F.col("stored_digest"), "left")
    own = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat(F.encode(F.concat("header", "http_header"), "UTF-8"), own,
                                             F.encode(F.lit(EOL * 2), "UTF-8")).alias("record"))


def archive_summary(pages: DataFrame, folder: str) -> DataFrame:
    """Write, read back, and return page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
