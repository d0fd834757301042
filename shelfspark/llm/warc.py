"""Derivative WARC records: metadata and plain text made from response records.

Each response gives one ``metadata`` and one ``conversion`` record. Both refer to
the response by its id and keep its address, date and payload digest; the metadata
lists the response's HTTP header, its title and its derivative. Record ids are made
from the response's id, so a repeated job writes the same records. All of it is
column functions; the text of a page is made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.html import html_title, html_to_text

END = "\r\n"
# Names and formats of WARC/1.1.
VERSION = "WARC/1.1"
KINDS = ["metadata", "conversion"]


def urn(kind: str, seed: Column) -> Column:
    """A record id that follows from ``seed``."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), seed))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def field(name: str, value: Column) -> Column:
    """A header line; null values give none. Line breaks in a value become blanks."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(END)))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record_id, target_uri, date, http_header, payload, payload_digest) from page_id, url, html.

    A null page has an empty payload. Rows equal in page_id and url have one record id.
    """
    payload = F.coalesce("html", F.lit(""))
    header = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(END),
    )
    seed = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    return pages.select(
        F.col("page_id"),
        urn("response", seed).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        header.alias("http_header"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def derivatives(responses: DataFrame, keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """Two records for each response: ``keep``, then the record's parts and its header.

    (warc_type, record_id, refers_to, target_uri, content_type, content_length,
    block_digest, source_digest, header, block). A null address leaves its line out, a
    null payload is empty. An empty table has no records; repeated rows give repeated
    records.
    """
    source = responses.select(
        *keep,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "payload_digest",
        "http_header",
        html_title(F.coalesce("payload", F.lit(""))).alias("_title"),
        html_to_text(F.coalesce("payload", F.lit(""))).alias("_text"),
    )
    http = F.transform(
        F.filter(F.split(F.coalesce("http_header", F.lit("")), END), lambda line: line != ""),
        lambda line: F.concat(F.lit("http-header: "), line, F.lit(END)),
    )
    fields = F.concat(
        F.array_join(http, ""),
        F.coalesce(field("payload-digest", F.col("payload_digest")), F.lit("")),
        F.coalesce(field("title", F.nullif("_title", F.lit(""))), F.lit("")),
        field("derivative", urn("conversion", F.col("refers_to"))),
        field("text-digest", digest(F.col("_text"))),
    )
    blocks = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("_text").alias("block")),
    )
    rows = source.select(*keep, "refers_to", "target_uri", "date", "payload_digest", F.explode(blocks).alias("r")).select(
        *keep,
        F.col("r.kind").alias("warc_type"),
        F.when(F.col("r.kind") == "metadata", urn("metadata", F.col("refers_to"))).otherwise(urn("conversion", F.col("refers_to"))).alias("record_id"),
        "refers_to",
        "target_uri",
        F.col("r.type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"),
        "date",
        F.col("r.block").alias("block"),
    )
    lines = [
        field("WARC-Type", F.col("warc_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Block-Digest", F.col("block_digest")),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.col("content_length").cast("string")),
    ]
    header = F.concat(F.lit(VERSION + END), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(END))
    names = ["warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest"]
    return rows.select(*keep, *names, header.alias("header"), "block")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records as WARC files, one for each task: header, block, two line ends."""
    records.select(F.concat("header", "block").alias("value")).write.option("lineSep", END + END).text(path)
