"""Raw mail -> message rows."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email.message import Message

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions import addresses as ad

_PARSED = (
    "id string, sender string, subject string, date string, `to` string, cc string, body string, "
    "raw_headers map<string,array<string>>, error string")
MESSAGE_SCHEMA = (
    "id string, sender string, sender_email string, sender_domain string, subject string, date string, "
    "received_at timestamp_ntz, `to` string, cc string, body string, raw_headers map<string,array<string>>, error string")

# Month abbreviations of mail dates, in order.
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MAIL_DATE = r"(\d{1,2})\s+([A-Z][a-z]{2})\s+(\d{4})\s+(\d{2}:\d{2}(?::\d{2})?)"
_ISO_DATE = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?"


def ingest_mail(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` as one message."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_mail(files.select(F.col("path").alias("id"), "content"))


def parse_mail(raw: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, content BINARY) -> messages. A mail that cannot be read gives a row with ``error``. The columns named in
    ``carried`` come along."""
    beside = [f for f in raw.schema.fields if f.name in carried]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _parse_batch(batch).assign(**{name: batch[name] for name in carried})

    schema = ", ".join([_PARSED, *(f"`{f.name}` {f.dataType.simpleString()}" for f in beside)])
    parsed = raw.select(F.col("id").cast("string").alias("id"), "content", *[f.name for f in beside]).mapInPandas(parse, schema)
    address = ad.extract_address(F.col("sender"))
    return parsed.select(
        "id", "sender", address.alias("sender_email"), ad.sender_domain(address).alias("sender_domain"),
        "subject", "date", received_at(F.col("date")).alias("received_at"), "to", "cc", "body", "raw_headers", "error", *carried)


def good_mail(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("error").isNull()).drop("error")


def failed_mail(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("error").isNotNull()).select("id", "error")


def received_at(date: Column) -> Column:
    """Wall clock time of a mail date or an ISO date, as written; NULL when neither."""
    month = F.lit(None).cast("int")
    for number, name in enumerate(_MONTHS, 1):
        month = F.when(F.regexp_extract(date, _MAIL_DATE, 2) == name, number).otherwise(month)
    clock = F.regexp_extract(date, _MAIL_DATE, 4)
    mail = F.format_string(
        "%s-%02d-%02dT%s", F.regexp_extract(date, _MAIL_DATE, 3), month,
        F.try_to_number(F.regexp_extract(date, _MAIL_DATE, 1), F.lit("99")).cast("int"), clock)
    iso = F.regexp_extract(date, _ISO_DATE, 0)
    return F.when(iso != "", _as_time(iso)).when(month.isNotNull(), _as_time(mail))


def _as_time(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def unread_only(messages: DataFrame) -> DataFrame:
    return messages.filter("was_unread")


def newest_first(messages: DataFrame) -> DataFrame:
    return messages.orderBy(F.desc("received_at"), F.desc("msg_id"))


def valid_ids(messages: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id consists of digits."""
    return messages.filter(F.rlike(F.col(column), F.lit("^[0-9]+$")))


def _parse_batch(batch: pd.DataFrame) -> pd.DataFrame:
    rows = [_read_one(i, c) for i, c in zip(batch["id"], batch["content"])]
    return pd.DataFrame(rows, columns=["id", "sender", "subject", "date", "to", "cc", "body", "raw_headers", "error"], index=batch.index)


def _read_one(mail_id: str, content: bytes) -> tuple:
    try:
        mail = email.message_from_bytes(bytes(content))
        fields = [_text(mail.get(name)) for name in ("From", "Subject", "Date", "To", "Cc")]
        headers: dict[str, list[str]] = {}
        for name, value in mail.items():
            headers.setdefault(name, []).append(_text(value))
        return (mail_id, *fields, _plain_text(mail), headers, None)
    except Exception as problem:
        return (mail_id, None, None, None, None, None, None, None, f"{type(problem).__name__}: {problem}")


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _plain_text(mail: Message) -> str:
    """All text/plain parts of a multipart mail in order, or the whole payload of a simple one."""
    parts = [p for p in mail.walk() if p.get_content_type() == "text/plain"] if mail.is_multipart() else [mail]
    return "".join(p.get_payload(decode=True).decode("utf-8", errors="ignore") for p in parts)
