"""Keyed state over streams: sender totals with their automatic list events, running counters, closed days.

Hot keys are combined before the shuffle: a task sends one row for each sender (or day and method) of its part of a
micro-batch, so a sender with a third of all feedback reaches its state as a few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailsieve.config import EngineConfig
from mailsieve.functions import fixed_values as fv
from mailsieve.functions import text as tx
from mailsieve.operators import feedback as fb
from mailsieve.operators import stats
from mailsieve.sources import tables

_COUNTS = tuple(fb.COUNTERS.values())
_PARTIAL = "sender_email string, sender_domain string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_us long, last_us long, run long"
_TOTALS = (
    "sender_email string, sender_domain string, " + ", ".join(f"{c} long" for c in _COUNTS)
    + ", first_us long, last_us long, run long, crossed array<string>")
_STATE = "domain string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_us long, last_us long, blacklisted boolean, whitelisted boolean"
#: senders that a task combines before it passes them on
_HELD = 100_000


def with_state_store(spark: SparkSession) -> None:
    """State on disk beside the executors, checkpointed with the stream; the state operators below need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each sender of a task: counts add up, times and domains are extremes."""
    how = {"sender_domain": "min", **dict.fromkeys(_COUNTS, "sum"), "first_us": "min", "last_us": "max", "run": "max"}
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch])
        rows = rows.assign(sender_domain=rows["sender_domain"].astype("string"))
        held = rows.groupby("sender_email", sort=False, as_index=False).agg(how)
        if len(held) >= _HELD:
            yield held
            held = None
    if held is not None:
        yield held


class SenderTotals(StatefulProcessor):
    """Totals of a sender, kept between batches and, with a time to live, forgotten after it. A list event is given
    once: in the batch whose correction finds the total at the threshold."""

    def __init__(self, config: EngineConfig, ttl_days: int | None):
        self.config, self.ttl_days = config, ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl_days is None else self.ttl_days * 86_400_000
        self.state = handle.getValueState("totals", _STATE, ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else (None, 0, 0, 0, 0, None, None, False, False)
        domain, counts, first, last, black, white = known[0], list(known[1:5]), known[5], known[6], known[7], known[8]
        new = dict.fromkeys(_COUNTS, 0)
        run = 0
        for batch in rows:
            for name in _COUNTS:
                new[name] += int(batch[name].sum())
            domains = [d for d in batch["sender_domain"] if d is not None and not pd.isna(d)]
            domain = min([*domains, *([] if domain is None else [domain])], default=None)
            first = min(int(batch["first_us"].min()), *([] if first is None else [first]), int(batch["first_us"].min()))
            last = max(int(batch["last_us"].max()), *([] if last is None else [last]), int(batch["last_us"].max()))
            run = max(run, int(batch["run"].max()))
        totals = dict(zip(_COUNTS, (a + new[c] for a, c in zip(counts, _COUNTS))))
        crossed = []
        if new["spam_count"] and not black and totals["spam_count"] + totals["blacklist_count"] >= self.config.auto_blacklist_threshold:
            crossed, black = [*crossed, "blacklist"], True
        if new["ham_count"] and not white and totals["ham_count"] + totals["whitelist_count"] >= self.config.auto_whitelist_threshold:
            crossed, white = [*crossed, "whitelist"], True
        self.state.update((domain, *totals.values(), first, last, black, white))
        yield pd.DataFrame({
            "sender_email": [key[0]], "sender_domain": pd.Series([domain], dtype="object"), **{c: [n] for c, n in totals.items()},
            "first_us": [first], "last_us": [last], "run": [run], "crossed": [crossed]})

    def close(self) -> None:
        pass


def sender_totals_stream(feedback: DataFrame, config: EngineConfig = EngineConfig(), ttl_days: int | None = None) -> DataFrame:
    """For each sender of a micro-batch its new totals, and in ``crossed`` the lists it comes onto by this batch.
    ``run`` is the largest of the feedback's column of that name, if it has one."""
    with_state_store(feedback.sparkSession)
    kind = F.col("feedback_type")
    moment = F.unix_micros(F.col("at").cast("timestamp"))
    rows = feedback.select(
        F.lower(tx.or_empty(F.col("sender_email"))).alias("sender_email"), F.lower("sender_domain").alias("sender_domain"),
        *[F.coalesce((kind == name).cast("long"), F.lit(0)).alias(column) for name, column in fb.COUNTERS.items()],
        F.coalesce(moment, F.lit(0)).alias("first_us"), F.coalesce(moment, F.lit(0)).alias("last_us"),
        (F.col("run").cast("long") if "run" in feedback.columns else F.lit(0).cast("long")).alias("run"))
    grouped = rows.mapInPandas(_combined, _PARTIAL).groupBy("sender_email")
    return grouped.transformWithStateInPandas(
        statefulProcessor=SenderTotals(config, ttl_days), outputStructType=_TOTALS, outputMode="Append",
        timeMode="None" if ttl_days is None else "ProcessingTime")


_KEPT = f"sender_email string, {_STATE}"


def sender_totals_round(root: str, config: EngineConfig = EngineConfig()) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: what ``sender_totals_stream`` gives without a time to live, by joins and aggregations only,
    for streams of many senders, as the state operator calls Python for each. The totals are a table of change rows under
    ``root``/totals, of which a batch reads its senders; its log rows go to ``root``/log (``totals_log``). A repeated
    batch reads the totals it started from and writes the same versions again."""
    root = root.rstrip("/")

    def round(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind, moment = F.col("feedback_type"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(0))
        run = F.max("run").cast("long") if "run" in batch.columns else F.lit(0).cast("long")
        new = batch.groupBy(F.lower(tx.or_empty(F.col("sender_email"))).alias("sender_email")).agg(
            F.min(F.lower("sender_domain")).alias("_domain"), *[F.count_if(kind == name).alias(f"_{c}") for name, c in fb.COUNTERS.items()],
            F.min(moment).alias("_first"), F.max(moment).alias("_last"), F.coalesce(run, F.lit(0)).alias("run"))
        senders = batch.select(F.lower(tx.or_empty(F.col("sender_email"))).alias("sender_email")).distinct()
        prior = tables.read_state(spark, f"{root}/totals", _KEPT, number, only=senders)
        rows = new.join(prior, "sender_email", "left").select(
            "sender_email", F.least("_domain", "domain").alias("sender_domain"),
            *[(F.coalesce(c, F.lit(0)) + F.col(f"_{c}")).alias(c) for c in _COUNTS],
            F.least("_first", "first_us").alias("first_us"), F.greatest("_last", "last_us").alias("last_us"), "run",
            (F.col("_spam_count") > 0).alias("_spam"), (F.col("_ham_count") > 0).alias("_ham"),
            *[F.coalesce(c, F.lit(False)).alias(c) for c in ("blacklisted", "whitelisted")])
        black = F.col("_spam") & ~F.col("blacklisted") & (F.col("spam_count") + F.col("blacklist_count") >= config.auto_blacklist_threshold)
        white = F.col("_ham") & ~F.col("whitelisted") & (F.col("ham_count") + F.col("whitelist_count") >= config.auto_whitelist_threshold)
        crossed = F.array_compact(F.array(F.when(black, F.lit("blacklist")), F.when(white, F.lit("whitelist"))))
        log = rows.withColumns({
            "crossed": crossed, "blacklisted": F.col("blacklisted") | black, "whitelisted": F.col("whitelisted") | white}).drop("_spam", "_ham")
        tables.write_version(log, f"{root}/log", number + 1)
        written = tables.read_latest(spark, f"{root}/log", log.schema, number + 1)
        kept = written.select("sender_email", F.col("sender_domain").alias("domain"), *_COUNTS, "first_us", "last_us", "blacklisted", "whitelisted")
        tables.write_changes(kept, f"{root}/totals", number + 1, ["sender_email"])
        tables.compact(spark, f"{root}/totals")

    return round


def totals_log(spark: SparkSession, root: str) -> DataFrame:
    """The log of all committed batches of ``sender_totals_round``."""
    names = [part.split()[0] for part in _TOTALS.split(", ")]
    return tables.read_committed(spark, f"{root.rstrip('/')}/log").select(*names)


def latest_totals(log: DataFrame) -> DataFrame:
    """The history that a log of ``sender_totals_stream`` leaves: the newest totals of each sender."""
    size = sum((F.col(c) for c in _COUNTS[1:]), F.col(_COUNTS[0]))
    rest = [c for c in log.columns if c != "sender_email"]
    newest = log.groupBy("sender_email").agg(F.max_by(F.struct(*rest), F.struct("last_us", size)).alias("e")).select("sender_email", "e.*")
    times = [F.timestamp_micros(f"{n}_us").cast("timestamp_ntz").alias(f"{n}_seen") for n in ("first", "last")]
    return newest.select("sender_email", "sender_domain", *_COUNTS, *times)


def list_events(log: DataFrame) -> DataFrame:
    """The automatic list events of a log, each with the item to insert: one row for a sender and a list."""
    events = log.select("run", "sender_email", "sender_domain", F.explode("crossed").alias("list_type"))
    email, domain = F.col("sender_email"), F.col("sender_domain")
    target = F.when(F.col("list_type") == "blacklist", fb.blacklist_target(email, domain, automatic=True)).otherwise(
        fb.whitelist_target(email, domain))
    return events.withColumn("t", target).select("run", "sender_email", "sender_domain", "list_type", "t.item_type", "t.raw_item")


def running_counter_round(root: str, config: EngineConfig = EngineConfig()) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each feedback of a batch with its sender's counters right after it, which include all
    batches before. The senders' totals are a table of change rows under ``root``/history, the counted feedback goes to
    ``root``/running. A repeated batch reads the totals it started from and writes the same versions again."""
    root = root.rstrip("/")

    def round(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            senders = batch.select(F.lower(tx.or_empty(F.col("sender_email"))).alias("sender_email")).distinct()
            prior = tables.read_state(spark, f"{root}/history", fb.HISTORY_SCHEMA, number, only=senders)
            tables.write_version(fb.running_counters(batch, prior, config), f"{root}/running", number + 1)
            tables.write_changes(fb.sender_counters(batch, prior), f"{root}/history", number + 1, ["sender_email"])
            tables.compact(spark, f"{root}/history")
        finally:
            batch.unpersist()

    return round


RECENT_SCHEMA = "seq long, processing_time double"


def recent_times_round(root: str, last: int = 1000) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the ``last`` positive processing times by number, over all batches so far, as versions of a
    table of at most ``last`` rows under ``root``. A task passes on no more than ``last`` rows. A repeated batch starts
    from the version before it and writes its own again; rows without a number or a time take no part."""
    def round(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = tables.read_latest(spark, root, RECENT_SCHEMA, number) if number else spark.createDataFrame([], RECENT_SCHEMA)
        fresh = batch.where("processing_time > 0 AND seq IS NOT NULL").select(F.col("seq").cast("long"), F.col("processing_time").cast("double"))
        rows = before.unionByName(fresh).orderBy(F.desc("seq"), F.desc("processing_time")).limit(last)
        tables.write_version(rows, root, number + 1)

    return round


def recent_average(spark: SparkSession, root: str) -> DataFrame:
    """The mean of the newest version of ``recent_times_round``, 0 without any."""
    return stats.avg_processing_time(tables.read_latest(spark, root, RECENT_SCHEMA))


_FACT = "at timestamp, method string, n long, spam long, fed long, failed long"


def closed_days_stream(decisions: DataFrame, feedback: DataFrame, errors: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each day once, when all three streams have passed it by ``lateness``: counts of decisions, feedback and errors,
    and the detections of each counted method. For append output; rows of days that are closed count in ``late_rows``."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def facts(stream: DataFrame, at: str, method=F.lit(None).cast("string"), **counts) -> DataFrame:
        rows = stream.select(F.col(at).cast("timestamp").alias("at"), method.alias("method"),
                             *[counts.get(c, zero).alias(c) for c in ("n", "spam", "fed", "failed")])
        return rows.withWatermark("at", lateness)

    decided = facts(decisions, "decided_at", F.col("method"), n=one, spam=(F.col("action") == "SPAM").cast("long"))
    rows = decided.unionByName(facts(feedback, "at", fed=one)).unionByName(facts(errors, "at", failed=one))
    sums = [F.sum(c).alias(c) for c in ("n", "spam", "fed", "failed")]
    methods = rows.groupBy(F.window("at", "1 day"), "method").agg(*sums)
    known = F.col("method").isin(*fv.COUNTED_METHODS)
    days = methods.groupBy(F.window("window", "1 day")).agg(
        *sums, F.map_from_entries(F.array_sort(F.collect_list(F.when(known, F.struct("method", "n"))))).alias("methods_used"))
    return days.select(
        F.to_date("window.start").alias("day"), F.col("n").alias("emails_processed"), F.col("spam").alias("spam_detected"),
        (F.col("n") - F.col("spam")).alias("ham_detected"), F.col("fed").alias("feedback_processed"), F.col("failed").alias("errors"),
        "methods_used")


def late_rows(closed: DataFrame, decisions: DataFrame, feedback: DataFrame, errors: DataFrame) -> DataFrame:
    """day and the decisions, feedback and errors that came after their day was closed and stand in no count of
    ``closed``, from the facts themselves."""
    def per_day(facts: DataFrame, at: str, name: str) -> DataFrame:
        return facts.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias(name))

    out = closed.select("day", "emails_processed", "feedback_processed", "errors")
    for facts, at, counted, name in ((decisions, "decided_at", "emails_processed", "late_decisions"), (feedback, "at", "feedback_processed", "late_feedback"),
                                     (errors, "at", "errors", "late_errors")):
        out = out.join(per_day(facts, at, "_all"), "day", "left").withColumn(name, F.coalesce("_all", F.lit(0)) - F.col(counted)).drop("_all")
    return out.select("day", "late_decisions", "late_feedback", "late_errors").where("late_decisions + late_feedback + late_errors > 0")
