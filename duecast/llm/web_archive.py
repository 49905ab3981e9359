"""A content-addressed WARC archive.

``payloads`` holds every distinct payload once, under its SHA-256; ``headers`` holds the exact header bytes of every record
beside the digest of its payload. Records are put together again by a join on the digest. Digests are verified twice:
when writing, rows of one digest must agree in length and in a second digest; when reading, bytes must give their key.

Which row of equal payloads stores the bytes is found on digests alone, so that writing moves no payload between tasks
as long as the repeated digests fit a broadcast; reading moves each stored payload once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecast.session import materialize

#: Equal payloads of at least so many bytes become revisits of one response.
LEAST_BYTES = 1000
#: Repeated digests up to which they are sent to every executor (about 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000

# The format's names.
VERSION, DATE = "WARC/1.1", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE, END = "\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    """The record's header and that of the response inside it."""
    # Control characters would end the line; in an address they are written in percent form.
    uri = F.col("url")
    for code in [*range(32), 127]:
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    inner = F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit(END))
    length = F.length(inner) + F.when(F.col("kind") == "response", F.col("n")).otherwise(0)
    fields = F.concat_ws(
        LINE,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("kind") == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}{LINE}WARC-Refers-To: "), _record_id(F.col("last")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    )
    return F.concat(fields, F.lit(END), inner).cast("binary")


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """One record per row: ``{path}/headers`` and ``{path}/payloads``.

    Of rows with equal payloads of ``LEAST_BYTES`` or more the one with the largest number is the response and the others
    revisit it; where that row is repeated, or no row has a number, all such rows are responses. Null payloads are empty,
    a null address has no line of its own. A missing number is written as ``none``. Repeated rows give repeated records; an
    empty table gives an empty archive. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256))
    facts = materialize(rows.select("page_id", "url", F.length("payload").cast("long").alias("n"), digest.alias("digest"), F.sha1("payload").alias("sha1")), "page-digests")
    same = facts.groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count(F.lit(1)).alias("rows"),
        ((F.min("n") == F.max("n")) & (F.min("sha1") == F.max("sha1"))).alias("agrees"),
    )
    repeated = materialize(same.where("rows > 1"), "repeated-payloads")
    if not repeated.where("not agrees").isEmpty():
        raise ValueError("Two payloads of other length or SHA-1 share a SHA-256 digest; nothing is stored.")
    repeated = _hinted(repeated.select("digest", "last", F.lit(True).alias("again")))
    revisits = F.col("again") & (F.col("n") >= LEAST_BYTES) & ~F.col("page_id").eqNullSafe(F.col("last"))
    kinds = facts.join(repeated, "digest", "left").withColumn("kind", F.when(revisits, "revisit").otherwise("response"))
    kinds.select("page_id", "digest", _header(date).alias("header")).write.parquet(f"{path}/headers")
    marked = rows.withColumn("digest", digest).join(repeated, "digest", "left")
    alone = marked.where("again is null").select("digest", "payload")
    first = marked.where(F.col("again") & F.col("page_id").eqNullSafe(F.col("last"))).select("digest", "payload").dropDuplicates(["digest"])
    alone.unionByName(first).write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, declared_digest, payload, record) of every record.

    ``payload`` is the full payload also for revisits; ``record`` is the record's bytes as they stand in a WARC file.
    Bytes that do not give their digest, and records without stored bytes, end the read with an error.
    """
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    stored = stored.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("A stored payload does not give its digest.")).cast("binary")).alias("payload"))
    headers = spark.read.schema("page_id long, digest binary, header binary").parquet(f"{path}/headers")
    joined = headers.join(stored, "digest", "left").withColumn("payload", F.coalesce("payload", F.raise_error(F.lit("A record's payload is not in the archive.")).cast("binary")))
    text = F.decode("header", "UTF-8")

    def line(name: str, pattern: str) -> Column:
        return F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1)

    kind = line("WARC-Type", "([a-z]+)")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(
        line("WARC-Record-ID", "<urn:page:(-?[0-9]*|none)>").try_cast("long").alias("page_id"),
        kind.alias("record_type"),
        line("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").try_cast("long").alias("refers_to"),
        line("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("declared_digest"),
        "payload",
        F.concat("header", body, F.lit(END.encode())).alias("record"),
    )


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), counted on the reconstructed payloads."""
    records = read_records(spark, path)
    found = F.sha1("payload")
    held = F.when(found == F.col("declared_digest"), found).otherwise(F.raise_error(F.lit("A payload does not give the digest in its header.")).cast("string"))
    return records.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), held.alias("payload_digest"), "record_type", "refers_to")
