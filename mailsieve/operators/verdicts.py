"""Stored verdicts: overrides, cache, and first-seen deduplication, all keyed by fingerprint.

First and latest rows are taken with min_by/max_by: they combine on the map side, so a fingerprint that
holds a third of all rows still reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_COLUMNS = ("fingerprint", "action", "reason", "confidence", "method", "override", "cached_at")


def pick_row(frame: DataFrame, keys: Sequence[str], order: Column, latest: bool = False) -> DataFrame:
    """One whole row per key: the first by ``order``, or the latest."""
    rest = [c for c in frame.columns if c not in keys]
    choose = F.max_by if latest else F.min_by
    return frame.groupBy(*keys).agg(choose(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def dedup_decisions(decisions: DataFrame) -> DataFrame:
    """The first decision for every fingerprint."""
    return pick_row(decisions, ["fingerprint"], F.col("seq"))


def live_cache(cache: DataFrame, max_age_days: int, as_of: Column) -> DataFrame:
    """Drop entries older than max_age_days. 0 keeps everything; so does a missing time stamp."""
    if max_age_days <= 0:
        return cache
    oldest = as_of.cast("timestamp") - F.make_dt_interval(F.lit(max_age_days))
    return cache.filter(F.col("cached_at").isNull() | (F.col("cached_at").cast("timestamp") >= oldest))


def feedback_overrides(feedback: DataFrame) -> DataFrame:
    """Corrections -> one override per fingerprint, the latest one counting."""
    corrections = feedback.filter(F.col("feedback_type").isin("not_spam", "is_spam"))
    is_spam = F.col("feedback_type") == "is_spam"
    rows = corrections.select(
        "fingerprint", "handled",
        F.when(is_spam, "SPAM").otherwise("KEEP").alias("action"),
        F.when(is_spam, "User feedback: is spam").otherwise("User feedback: not spam").alias("reason"),
        F.lit(1.0).alias("confidence"), F.lit("user_feedback").alias("method"), F.lit(True).alias("override"),
        F.col("at").alias("cached_at"),
    )
    return pick_row(rows, ["fingerprint"], F.col("handled"), latest=True).select(*CACHE_COLUMNS)


def merge_cache(current: DataFrame, newer: DataFrame) -> DataFrame:
    """Newer entries replace older ones; every entry keeps its own time stamp."""
    both = current.select(*CACHE_COLUMNS, F.lit(0).alias("_gen")).unionByName(
        newer.select(*CACHE_COLUMNS, F.lit(1).alias("_gen")))
    return pick_row(both, ["fingerprint"], F.col("_gen"), latest=True).select(*CACHE_COLUMNS)


def is_override(method: Column, override: Column) -> Column:
    return (method == "user_feedback") | F.coalesce(override, F.lit(False))
