"""Derivatives of web captures: metadata and plain-text conversion records for each response.

A response record holds an HTTP message. Its two derivatives refer to it by its identifier and keep its address, date
and payload digest; the metadata record also keeps the source's headers, and both name each other. All work is Spark
expressions over one row per response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
BASE16_GROUP, BASE32_GROUP = 5, 4
#: Digits of numbers to the base 32, and the alphabet that digests are written in.
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Elements whose text is not shown, and elements that begin and end a line.
HIDDEN = ("script", "style", "noscript", "template")
LINES = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|"
    "pre|section|table|td|th|title|tr|ul"
)
#: Named characters, `amp` last, so that what it gives is not read again.
NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "copy": "©", "reg": "®", "middot": "·",
    "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€", "amp": "&",
}


def sha1_digest(block: Column) -> Column:
    """`sha1:` and the digest of the text's bytes in base 32."""
    digits = F.sha1(block)
    groups = [
        F.lpad(F.conv(F.substring(digits, at, BASE16_GROUP), 16, 32), BASE32_GROUP, "0") for at in range(1, 41, BASE16_GROUP)
    ]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), DIGITS, ALPHABET))


def record_id(*parts: Column) -> Column:
    """A `urn:uuid` made from what identifies the record, so that a rerun gives the same."""
    digits = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]))
    cuts = [F.substring(digits, at, length) for at, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of `page_id`, `url`, `html`: `page_id`, `record_id`, `target_uri`, `date` and `message`, an
    HTTP message. Null html is an empty page, a null url stays null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])
    message = F.concat(F.lit(head), F.octet_length(html).cast("string"), F.lit(CRLF * 2), html)
    return pages.select(
        "page_id", record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), message.alias("message"),
    )


def plain_text(html: Column) -> Column:
    """The text of a page: hidden elements, comments and tags out, one line per block, runs of space as one."""
    # One first character for all kinds, so that other places are passed over without trying each.
    hidden = "|".join(["!--.*?-->", *(rf"{name}\b[^>]*>.*?</{name}\s*>" for name in HIDDEN)])
    text = F.regexp_replace(html, f"(?is)<(?:{hidden})", "")
    text = F.regexp_replace(text, r"[\x09-\x0D]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{LINES})(?:[\x20/][^>]*)?>", "\n")
    text = F.regexp_replace(text, r"<[!?/a-zA-Z][^>]*>", "")
    for name, character in NAMED.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    text = F.regexp_replace(text, r"\x20*\n[\x20\n]*", "\n")
    return F.trim(F.regexp_replace(text, r"\x20{2,}", " "), F.lit(" \n"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records per response: `page_id`, `warc_type` (`metadata` or `conversion`), `record_id`, `refers_to`,
    `concurrent_to` (the other one), `target_uri`, `date`, `content_type`, `content_length`, `block_digest`,
    `source_payload_digest` and `block`.

    The payload is what follows the first empty line of the message; a message without one is all header and has an
    empty payload. Null messages are empty. Repeated responses each give their two records. Other columns are
    ignored. No rows in, no rows out.
    """
    message = F.coalesce(F.col("message"), F.lit(""))
    read = records.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.split_part(message, F.lit(CRLF * 2), F.lit(1)).alias("_head"), message.alias("_message"),
    )
    payload = F.expr("substring(_message, length(_head) + 5)")
    read = read.withColumn("_payload", payload).withColumn("_text", plain_text(F.col("_payload")))
    digest, title = sha1_digest(F.col("_payload")), F.regexp_extract("_payload", r"(?is)<title[^>]*>(.*?)</title", 1)
    fields = F.concat(
        F.lit("source-headers: "), F.replace("_head", F.lit(CRLF), F.lit("; ")), F.lit(CRLF),
        F.lit("title: "), F.trim(F.regexp_replace(title, r"[\x20\x09-\x0D]+", " ")), F.lit(CRLF),
        F.lit("language: "), F.lower(F.regexp_extract("_payload", r"""(?i)<html[^>]*\blang=["']?([a-zA-Z-]+)""", 1)), F.lit(CRLF),
        F.lit("outlinks: "), F.regexp_count("_payload", F.lit(r"(?i)<a\b[^>]*\bhref=")).cast("string"), F.lit(CRLF),
        F.lit("text-length: "), F.octet_length("_text").cast("string"), F.lit(CRLF),
    )
    ids = {kind: record_id(F.lit(kind), F.col("refers_to"), F.col("page_id")) for kind in ("metadata", "conversion")}
    two = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), ids["metadata"].alias("record_id"), ids["conversion"].alias("concurrent_to"),
                 F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), ids["conversion"].alias("record_id"), ids["metadata"].alias("concurrent_to"),
                 F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    made = read.select("page_id", "refers_to", "target_uri", "date", digest.alias("source_payload_digest"), F.inline(two))
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), sha1_digest(F.col("block")).alias("block_digest"),
        "source_payload_digest", "block",
    )


def serialised(made: DataFrame) -> DataFrame:
    """Each record as it stands in a file, without the two line ends after it: `page_id`, `record`."""
    header = {
        "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to",
        "WARC-Concurrent-To": "concurrent_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date",
        "Content-Type": "content_type", "Content-Length": "content_length", "WARC-Block-Digest": "block_digest",
        "WARC-Source-Payload-Digest": "source_payload_digest",
    }
    lines = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(CRLF)) for name, column in header.items()]
    lines = [F.coalesce(line, F.lit("")) for line in lines]  # a field without a value is left out
    return made.select("page_id", F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit(CRLF), F.col("block")).alias("record"))


def write_warc(made: DataFrame, path: str) -> None:
    """Compressed files of records, each followed by two line ends."""
    serialised(made).select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
