"""Statistics, always derived from the facts and never stored as counters.

decisions: fingerprint, seq, decided_at, action, confidence, method, processing_time - deduplicated
first with ``verdicts.dedup_decisions``. feedback, errors, retrains: facts with ``at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions import fixed_values as fv
from mailsieve.plans.session import materialize

BANDS = ("high", "medium", "low")


def _spam() -> Column:
    return F.col("action") == "SPAM"


def _share(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def detection_totals(decisions: DataFrame) -> DataFrame:
    """total, spam, ham (everything that is not spam), spam_rate in percent."""
    total, spam = F.count("*"), F.count_if(_spam())
    return decisions.agg(total.alias("total"), spam.alias("spam"), (total - spam).alias("ham")).withColumn(
        "spam_rate", _share(F.col("spam"), F.col("total"), 2))


def method_counts(decisions: DataFrame, all_methods: bool = False) -> DataFrame:
    """Detections per method. Only the counted methods, zeros included, unless ``all_methods``."""
    counts = decisions.groupBy("method").agg(F.count("*").alias("n"))
    if all_methods:
        return counts.withColumnRenamed("n", "detections")
    known = decisions.sparkSession.createDataFrame([(m,) for m in fv.COUNTED_METHODS], "method string")
    return known.join(counts, "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("detections"))


def effectiveness(decisions: DataFrame, all_methods: bool = False) -> DataFrame:
    """Count and share per method; no rows when nothing was counted."""
    counts = method_counts(decisions, all_methods)
    total = F.sum("detections").over(Window.partitionBy(F.lit(1)))  # a handful of rows
    return counts.withColumn("total", total).filter(F.col("total") > 0).select(
        "method", "detections", _share(F.col("detections"), F.col("total"), 2).alias("percentage"))


def confidence_bands(decisions: DataFrame) -> DataFrame:
    """high from 0.8, medium from 0.5, low below; share in percent."""
    c = F.col("confidence")
    band = F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
    counts = decisions.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    known = decisions.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    merged = known.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("detections"))
    total = F.sum("detections").over(Window.partitionBy(F.lit(1)))
    return merged.withColumn("share", _share(F.col("detections"), total, 1))


def avg_processing_time(decisions: DataFrame, last: int = 1000) -> DataFrame:
    """Mean of the last positive times: a top-k per task, then one merge of k rows."""
    recent = decisions.filter(F.col("processing_time") > 0).orderBy(F.desc("seq")).limit(last)
    return recent.agg(F.coalesce(F.round(F.avg("processing_time"), 3), F.lit(0.0)).alias("avg_processing_time"))


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """``feedback`` with ``ok``: whether the row was handled without error."""
    kind, ok = F.col("feedback_type"), F.col("ok")
    return feedback.agg(
        F.count_if(ok).alias("total_feedback"),
        F.count_if(ok & (kind == "whitelist")).alias("whitelist_additions"),
        F.count_if(ok & (kind == "blacklist")).alias("blacklist_additions"),
        F.count_if(ok).alias("ml_training_samples"),
        *[F.count_if(ok & (kind == t)).alias(f"feedback_{t}") for t in fv.FEEDBACK_TYPES])


def retrain_stats(retrains: DataFrame) -> DataFrame:
    done = retrains.filter("success")
    return done.agg(F.count("*").alias("ml_retraining_count"), F.max("at").alias("last_retrain_date"))


def error_stats(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count("*").alias("errors_count"), F.max("at").alias("last_error_date"))


def errors_per_day(errors: DataFrame) -> DataFrame:
    return errors.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("errors"))


DAILY_COUNTS = ("emails_processed", "spam_detected", "ham_detected", "feedback_processed", "errors")


def daily_stats(decisions: DataFrame, feedback: DataFrame, errors: DataFrame, days: int, as_of: Column) -> DataFrame:
    """The last ``days`` days up to as_of, days without activity as zeros.

    Each fact is cut to the window and aggregated per day before anything is joined. ``methods_used``
    maps counted methods to their detections.
    """
    last = F.to_date(as_of)
    first = F.date_sub(last, days - 1)

    def in_window(facts: DataFrame, at: str) -> DataFrame:
        # compared as time stamps, so that the condition can prune files
        start, end = first.cast("timestamp_ntz"), F.date_add(last, 1).cast("timestamp_ntz")
        return facts.filter((F.col(at) >= start) & (F.col(at) < end)).withColumn("day", F.to_date(at))

    spam = _spam()
    per_method = in_window(decisions, "decided_at").groupBy("day", "method").agg(
        F.count("*").alias("n"), F.count_if(spam).alias("s"))
    known = F.col("method").isin(*fv.COUNTED_METHODS)
    detected = per_method.groupBy("day").agg(
        F.sum("n").alias("emails_processed"), F.sum("s").alias("spam_detected"),
        F.sum(F.col("n") - F.col("s")).alias("ham_detected"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(known, F.struct("method", "n"))))).alias("methods_used"))
    fed = in_window(feedback, "at").groupBy("day").agg(F.count("*").alias("feedback_processed"))
    failed = in_window(errors, "at").groupBy("day").agg(F.count("*").alias("errors"))
    calendar = decisions.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    joined = calendar.join(detected, "day", "left").join(fed, "day", "left").join(failed, "day", "left")
    return joined.select(
        "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in DAILY_COUNTS],
        F.coalesce("methods_used", F.create_map().cast("map<string,bigint>")).alias("methods_used"))


def active_days(daily: DataFrame) -> DataFrame:
    """Days with mail, feedback or errors, newest first."""
    busy = (F.col("emails_processed") > 0) | (F.col("feedback_processed") > 0) | (F.col("errors") > 0)
    return daily.filter(busy).orderBy(F.desc("day"))


def summary(decisions: DataFrame, feedback: DataFrame, retrains: DataFrame, errors: DataFrame) -> DataFrame:
    """Everything above in one row. Totals, methods and bands are one aggregate; each part is a single row before the
    cross join."""
    c, total, spam = F.col("confidence"), F.count("*"), F.count_if(_spam())
    row = decisions.agg(
        total.alias("total"), spam.alias("spam"), (total - spam).alias("ham"), _share(spam, total, 2).alias("spam_rate"),
        *[F.count_if(F.col("method") == m).alias(f"method_{m}") for m in fv.COUNTED_METHODS],
        F.count_if(c >= 0.8).alias("confidence_high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("confidence_medium"),
        F.count_if(~(c >= 0.5)).alias("confidence_low"))
    for part in (avg_processing_time(decisions), feedback_totals(feedback), retrain_stats(retrains), error_stats(errors)):
        row = row.crossJoin(part)
    return row


def since_reset(facts: DataFrame, at: str, reset_at: Column | None) -> DataFrame:
    """Facts after the last reset; the facts themselves stay."""
    return facts if reset_at is None else facts.filter(F.col(at) > reset_at)


def reset_event(as_of: Column, confirm: bool = False) -> Column:
    if not confirm:
        raise ValueError("resetting statistics needs confirm=True")
    return as_of


def merge_stats(stored: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Stored rows of an older layout, with missing or NULL columns set to defaults."""
    have = set(stored.columns)
    return stored.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value) for name, value in defaults.items()})


def report(decisions: DataFrame, feedback: DataFrame, retrains: DataFrame, errors: DataFrame, as_of: Column,
           days: int = 30) -> DataFrame:
    """One JSON document: summary, daily statistics, effectiveness and, in ``raw_stats``, the counters themselves with
    all methods and all kinds of feedback. Sized by days and methods, not by mail. The decisions are computed once and
    read again as a narrow table."""
    names = ("seq", "decided_at", "action", "confidence", "method", "processing_time")
    decisions = materialize(decisions.select(*[n for n in names if n in decisions.columns]), "decisions")
    one = summary(decisions, feedback, retrains, errors).select(F.struct("*").alias("summary"))
    daily = daily_stats(decisions, feedback, errors, days, as_of).withColumn(
        "methods_used", F.array_sort(F.map_entries("methods_used"))).agg(
        F.sort_array(F.collect_list(F.struct("day", *DAILY_COUNTS, "methods_used"))).alias("daily_stats"))
    shares = effectiveness(decisions).agg(
        F.sort_array(F.collect_list(F.struct("method", "detections", "percentage"))).alias("effectiveness"))
    methods = method_counts(decisions, all_methods=True).where("method IS NOT NULL").agg(
        F.sort_array(F.collect_list(F.struct("method", "detections"))).alias("methods"))
    detection = detection_totals(decisions).crossJoin(methods).select(F.struct("total", "spam", "ham", "methods").alias("detection"))
    counters = [(feedback_totals(feedback), "feedback"), (retrain_stats(retrains), "learning"), (error_stats(errors), "errors")]
    for part, name in counters:
        detection = detection.crossJoin(part.select(F.struct("*").alias(name)))
    raw = detection.select(F.struct("*").alias("raw_stats"))
    whole = one.crossJoin(daily).crossJoin(shares).crossJoin(raw)
    return whole.select(F.to_json(F.struct(
        as_of.cast("string").alias("exported_at"), "summary", "daily_stats", "effectiveness", "raw_stats")).alias("report"))
