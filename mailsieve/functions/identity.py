"""Keys that identify a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions import text as tx


def fingerprint(sender_email: Column, subject: Column, body: Column) -> Column:
    """md5 over sender, subject and the first 200 characters of the body, without separators."""
    return F.md5(F.concat(tx.or_empty(sender_email), tx.or_empty(subject), F.substring(tx.or_empty(body), 1, 200)))


def training_key(sender_email: Column, subject: Column, content: Column) -> Column:
    """Key under which two training samples count as the same."""
    return F.md5(F.concat(tx.or_empty(sender_email), tx.or_empty(subject), F.substring(tx.or_empty(content), 1, 100)))


def split_key(row_id: Column, seed: int) -> Column:
    """Random-looking order that depends on the row and the seed only, not on partitioning."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))
