"""Mail cleaning: mailbox rows to labelled training rows, API rows to inbox rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions import html, sender
from exposight.functions import text as tx
from exposight.operators.labels import Keywords, with_labels
from exposight.operators.rows import first_per_key

SENDER_COLUMNS = ["sender_name", "sender_email_username", "sender_email_domain"]
MAIL_COLUMNS = SENDER_COLUMNS + ["original_sender_string", "subject", "body", "date"]
TRAINING_COLUMNS = MAIL_COLUMNS + [f"{label}_count" for label in fv.LABELS] + ["label"]
INBOX_COLUMNS = (
    ["gmail_id"] + MAIL_COLUMNS + ["is_read", "classification", "confidence", "processed", "created_at"]
)


def prepare_training(mails: DataFrame) -> DataFrame:
    """Rename and bring to the training table's columns with their defaults; keeps ``ordinal``."""
    filled = mails.withColumnRenamed("sender", "original_sender_string").withColumns(
        {c: F.lit("") for c in SENDER_COLUMNS}
        | {f"{label}_count": F.lit(0) for label in fv.LABELS}
        | {"label": F.lit("unlabelled")}
    )
    return filled.select("ordinal", *TRAINING_COLUMNS)


def prepare_inbox(mails: DataFrame) -> DataFrame:
    blank = ["is_read", "confidence", "processed", "created_at"]
    filled = mails.withColumnRenamed("sender", "original_sender_string").withColumns(
        {c: F.lit("") for c in SENDER_COLUMNS + blank} | {"classification": F.lit("unclassified")}
    )
    return filled.select(INBOX_COLUMNS)


def clean_subject(subject: Column) -> Column:
    return tx.strip(tx.drop_zero_width(html.strip_mail_markup(F.coalesce(subject, F.lit("")))))


def clean_body(body: Column) -> Column:
    return tx.strip(
        tx.collapse_spaces(tx.drop_zero_width(html.strip_mail_markup(F.coalesce(body, F.lit("")))))
    )


def clean_text(mails: DataFrame) -> DataFrame:
    """Subject and body without null, markup, zero-width characters and outer space;
    white space inside is collapsed in the body only."""
    return mails.withColumns({"subject": clean_subject(F.col("subject")), "body": clean_body(F.col("body"))})


def split_sender(mails: DataFrame, column: str = "original_sender_string") -> DataFrame:
    address = sender.sender_address(F.col(column))
    return mails.withColumns(
        {
            "sender_name": sender.sender_name(F.col(column)),
            "sender_email_username": sender.address_user(address),
            "sender_email_domain": sender.address_domain(address),
        }
    )


def keep_first_mail(mails: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First mail of every equal raw (subject, body), before any cleaning."""
    return first_per_key(mails, ["subject", "body"], order or ["ordinal"])


def training_rows(mails: DataFrame, keywords: Keywords = fv.KEYWORDS) -> DataFrame:
    """Mailbox rows to labelled training rows. ``ordinal`` orders the mailbox; rows of the mailbox scan are in the
    order of their files, blocks and places."""
    if "ordinal" not in mails.columns:
        mails = mails.withColumn("ordinal", F.struct("mail_file", "mail_block", "mail_seq"))
    distinct = keep_first_mail(prepare_training(mails))
    cleaned = split_sender(clean_text(distinct))
    return with_labels(cleaned, keywords=keywords).select("ordinal", *TRAINING_COLUMNS)


def inbox_rows(mails: DataFrame) -> DataFrame:
    """API rows cleaned the same way, neither deduplicated nor labelled."""
    return split_sender(clean_text(prepare_inbox(mails))).select(INBOX_COLUMNS)


def email_text(null_as_empty: bool = False) -> Column:
    """Sender, subject and body joined by one space; a null part makes it null unless told otherwise."""
    parts = [F.col(c) for c in ("original_sender_string", "subject", "body")]
    if null_as_empty:
        parts = [F.coalesce(p, F.lit("")) for p in parts]
    return F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2])
