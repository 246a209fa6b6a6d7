"""Mail sources: mbox files and landed raw API messages.

The JVM splits files into messages (or decodes base64); a small Arrow batch
function reads headers and MIME parts with the standard library.
"""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes
from email.message import Message

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = "sender string, subject string, date string, body string"


def _part_text(part: Message, replaced: bool) -> str:
    payload = part.get_payload(decode=True)
    text = payload.decode(errors="ignore") if payload else ""
    # The text source marks undecodable bytes of 8-bit bodies; the reader drops them.
    encoded = str(part.get("content-transfer-encoding", "")).lower() in ("base64", "quoted-printable")
    return text.replace(chr(0xFFFD), "") if replaced and not encoded else text


def _read_message(raw: bytes, replaced: bool) -> tuple[str, str, str, str]:
    message = message_from_bytes(raw)
    if message.is_multipart():
        parts = [p for p in message.walk() if p.get_content_type() == "text/plain"]
    else:
        parts = [message]
    body = "".join(_part_text(p, replaced) for p in parts)
    headers = (str(message.get(h, "")) for h in ("from", "subject", "date"))
    return (*headers, body)


def parse_messages(df: DataFrame, raw: str, replaced: bool = False) -> DataFrame:
    """Replace the binary column ``raw`` by ``sender, subject, date, body``."""
    kept = [c for c in df.columns if c != raw]
    schema = T.StructType([df.schema[c] for c in kept] + T.StructType.fromDDL(_FIELDS).fields)
    names = ["sender", "subject", "date", "body"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_read_message(bytes(r), replaced) for r in batch[raw]]
            parsed = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[kept], parsed], axis=1)

    return df.mapInPandas(read, schema)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """One row per message with its place: ``mail_file, mail_block, mail_seq`` order the messages.

    Messages are split at line starts ``From `` while scanning, so one large file
    is read by many tasks. As in any mbox, such a line inside a body has to be
    quoted (``>From ``) by the writer.
    """
    records = (
        spark.read.option("lineSep", "\nFrom ")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("mail_file"),
            F.col("_metadata.file_block_start").alias("mail_block"),
            F.monotonically_increasing_id().alias("mail_seq"),
            F.col("value"),
        )
    )
    # Drop the rest of the "From " line; a message ends with the newline before the blank line.
    message = F.regexp_replace(F.col("value"), r"^[^\n]*\n", "")
    message = F.when(message.endswith("\n"), message).otherwise(F.concat(message, F.lit("\n")))
    # In a file with CRLF line ends that newline is a CRLF, of which the separator took the LF.
    trimmed = F.regexp_replace(message, r"(\r?\n)\r?\n\z", "$1")
    raw = records.where(F.trim("value") != "").withColumn("raw", F.encode(trimmed, "UTF-8")).drop("value")
    return parse_messages(raw, "raw", replaced=True)


def decode_base64url(raw: Column) -> Column:
    return F.unbase64(F.translate(raw, "-_", "+/"))


def read_api_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed ``{id, raw}`` JSON lines to ``gmail_id, sender, subject, date, body``."""
    feed = spark.read.schema("id string, raw string").json(path)
    return parse_messages(
        feed.select(F.col("id").alias("gmail_id"), decode_base64url(F.col("raw")).alias("raw")), "raw"
    )


def first_ids(feed: DataFrame, n: int) -> DataFrame:
    """The first ``n`` message ids (a listing has a largest size)."""
    return feed.select("id").orderBy("id").limit(n)
