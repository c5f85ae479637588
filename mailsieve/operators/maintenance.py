"""Keeping mailboxes small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig


def old_spam(mailbox: DataFrame, days: int, as_of: Column, accounts: DataFrame | None = None,
             config: EngineConfig = EngineConfig()) -> DataFrame:
    """Messages of the spam folder received on a day before as_of - days. 0 or less selects nothing.

    The date condition is a plain comparison on received_at, so it reaches the scan and prunes files.
    """
    if days <= 0:
        return mailbox.filter(F.lit(False))
    return _with_spam_folder(mailbox.filter(_before(days, as_of)), accounts, config).filter(
        F.col("folder") == F.col("_spam")).drop("_spam")


def kept_mail(mailbox: DataFrame, days: int, as_of: Column, accounts: DataFrame | None = None,
              config: EngineConfig = EngineConfig()) -> DataFrame:
    """Everything ``old_spam`` leaves: the opposite condition per row, not a join of the mailbox with itself."""
    if days <= 0:
        return mailbox
    gone = _before(days, as_of) & (F.col("folder") == F.col("_spam"))
    return _with_spam_folder(mailbox, accounts, config).filter(~F.coalesce(gone, F.lit(False))).drop("_spam")


def _before(days: int, as_of: Column) -> Column:
    return F.col("received_at") < F.date_sub(F.to_date(as_of), days).cast("timestamp_ntz")


def _with_spam_folder(mailbox: DataFrame, accounts: DataFrame | None, config: EngineConfig) -> DataFrame:
    common = F.lit(config.spam_folder)
    if accounts is None:
        return mailbox.withColumn("_spam", common)
    side = accounts.select(F.col("name").alias("_acc"), F.col("spam_folder").alias("_own"))
    return mailbox.join(side, F.col("account") == F.col("_acc"), "left").withColumn(
        "_spam", F.coalesce("_own", common)).drop("_acc", "_own")


def purge_old_spam(mailbox: DataFrame, days: int, as_of: Column, accounts: DataFrame | None = None,
                   config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """(what is left, what goes)."""
    return kept_mail(mailbox, days, as_of, accounts, config), old_spam(mailbox, days, as_of, accounts, config)


def purge_counts(gone: DataFrame) -> DataFrame:
    return gone.groupBy("account").agg(F.count("*").alias("cleanup_deleted"))
