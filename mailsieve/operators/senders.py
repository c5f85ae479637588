"""Reports on recurring senders, over the sender history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.functions import features as ft


def _matching(history: DataFrame, threshold: int, spam_only: bool, ham_only: bool) -> DataFrame:
    rows = history.select(
        "sender_email", "sender_domain",
        (F.col("spam_count") + F.col("blacklist_count")).alias("spam"),
        (F.col("ham_count") + F.col("whitelist_count")).alias("ham"),
        "first_seen", "last_seen",
    ).withColumn("total", F.col("spam") + F.col("ham")).filter(F.col("total") >= threshold)
    if spam_only:
        rows = rows.filter(F.col("spam") > 0)
    if ham_only:
        rows = rows.filter(F.col("ham") > 0)
    return rows


def list_status(config: EngineConfig) -> Column:
    """AUTO-BLACKLISTED and/or AUTO-WHITELISTED."""
    return F.array_compact(F.array(
        F.when(F.col("spam") >= config.auto_blacklist_threshold, "AUTO-BLACKLISTED"),
        F.when(F.col("ham") >= config.auto_whitelist_threshold, "AUTO-WHITELISTED")))


def remaining(count: Column, threshold: int) -> Column:
    """Feedbacks left to a threshold, NULL when none were given yet or it is reached."""
    return F.when((count > 0) & (count < threshold), F.lit(threshold) - count)


def recurring_senders(history: DataFrame, as_of: Column, *, threshold: int = 2, limit: int = 20, spam_only: bool = False,
                      ham_only: bool = False, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Top senders by feedback; ties by address."""
    top = _matching(history, threshold, spam_only, ham_only).orderBy(F.desc("total"), "sender_email").limit(limit)
    return top.withColumns({
        "status": list_status(config),
        "to_blacklist": remaining(F.col("spam"), config.auto_blacklist_threshold),
        "to_whitelist": remaining(F.col("ham"), config.auto_whitelist_threshold),
        "days_since_last": ft.whole_days(F.col("last_seen"), as_of).cast("bigint"),
    })


def recurring_summary(history: DataFrame, *, threshold: int = 2, limit: int = 20, spam_only: bool = False,
                      ham_only: bool = False, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Totals over all matching senders, not just the shown ones."""
    known = history.agg(F.count("*").alias("senders_in_history"))
    found = _matching(history, threshold, spam_only, ham_only).agg(
        F.count("*").alias("matching"),
        F.least(F.count("*"), F.lit(limit)).alias("shown"),
        F.count_if(F.col("spam") > 0).alias("spam_senders"),
        F.count_if(F.col("ham") > 0).alias("ham_senders"),
        F.count_if(F.col("spam") >= config.auto_blacklist_threshold).alias("auto_blacklisted"),
        F.count_if(F.col("ham") >= config.auto_whitelist_threshold).alias("auto_whitelisted"))
    return known.crossJoin(found)  # one row each
