"""Streaming forms: continuous classification, deduplication, sender counters, daily statistics.

Checkpoints and state live in the shared folder of the cluster. Counters and daily statistics are
built-in streaming aggregations: each micro-batch is combined per task before the shuffle, so a sender
that sends a third of all feedback costs one row per task.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailsieve.config import EngineConfig
from mailsieve.operators import cascade, feedback as fb, lists, training, verdicts
from mailsieve.plans import jobs
from mailsieve.sources import tables


def _event_time(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("decided_at", F.col("decided_at").cast("timestamp"))


def dedup_stream(decisions: DataFrame, lateness: str = "30 days") -> DataFrame:
    """First arrival per fingerprint. State older than the watermark is dropped, nothing by chance."""
    return _event_time(decisions).withWatermark("decided_at", lateness).dropDuplicatesWithinWatermark(["fingerprint"])


def sender_counter_stream(feedback: DataFrame) -> DataFrame:
    """Running totals per sender, for complete output, or for update output merged by sender_email."""
    return fb.sender_counters(feedback)


def auto_list_events(totals: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Senders whose totals have reached a threshold, with the list item to insert."""
    spam = F.col("spam_count") + F.col("blacklist_count")
    ham = F.col("ham_count") + F.col("whitelist_count")
    email, domain = F.col("sender_email"), F.col("sender_domain")
    black = F.when((F.col("spam_count") > 0) & (spam >= config.auto_blacklist_threshold), F.struct(
        F.lit("blacklist").alias("list_type"), fb.blacklist_target(email, domain, automatic=True).alias("target")))
    white = F.when((F.col("ham_count") > 0) & (ham >= config.auto_whitelist_threshold), F.struct(
        F.lit("whitelist").alias("list_type"), fb.whitelist_target(email, domain).alias("target")))
    rows = totals.select("sender_email", "sender_domain", F.explode(F.array_compact(F.array(black, white))).alias("e"))
    return rows.select("sender_email", "sender_domain", "e.list_type", "e.target.item_type", "e.target.raw_item")


def daily_stats_stream(decisions: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Per day: processed, spam, ham. Rows later than the watermark are left out."""
    spam = F.col("action") == "SPAM"
    day = F.window("decided_at", "1 day")
    return _event_time(decisions).withWatermark("decided_at", lateness).groupBy(day).agg(
        F.count("*").alias("emails_processed"), F.count_if(spam).alias("spam_detected"), F.count_if(~spam).alias("ham_detected")
    ).select(F.to_date("window.start").alias("day"), "emails_processed", "spam_detected", "ham_detected")


def start_to_table(stream: DataFrame, path: str, mode: str = "append", available_now: bool = False,
                   seconds: int = EngineConfig().poll_seconds, checkpoint: str | None = None,
                   keys: tuple[str, ...] = ()) -> StreamingQuery:
    """Run a stream into a parquet folder. The checkpoint lies beside the data unless named, so that a stream that
    is started again goes on where it was. In complete mode each micro-batch is one version; in update mode it
    holds the change rows of its keys, which readers fold, and the table is compacted as it grows."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that rows are merged by")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{path.rstrip('/')}/_checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
    if mode == "append":
        return writer.format("parquet").start(path)
    if mode == "update":
        def changed(batch: DataFrame, number: int) -> None:
            tables.write_changes(batch, path, number, list(keys))
            tables.compact(batch.sparkSession, path)

        return writer.foreachBatch(changed).start()
    return writer.foreachBatch(lambda batch, number: tables.write_version(batch, path, number)).start()


class MailService:
    """Poll for mail and feedback: each round learns from the feedback first, then classifies the mail.

    Lists, history and cache are tables of change rows under ``root``: a round writes what it changes. Every round reads
    the state of the rounds before, so a change shows in the next round. A round that is repeated after a failure reads
    the versions that round started from and writes the same version numbers again, so results do not depend on the
    failure.

    Training samples come from feedback and from confident scorer verdicts, two pools. When a pool has
    ``retrain_threshold`` samples since the training that last took it in, the forest is trained anew on all samples
    with the senders' history; the model is committed by its record in ``retrains``. A round uses the newest committed
    model, so running services take up a new one at the next round and a started one goes on with the last.

    Mail rows with ``error`` set could not be read; they are counted as errors and not classified.
    """

    def __init__(self, spark: SparkSession, root: str, accounts: DataFrame, *, as_of: Callable[[], Column] = F.current_timestamp,
                 config: EngineConfig = EngineConfig(), model: PipelineModel | None = None,
                 scorer: cascade.Scorer | None = None, provider: str = "openai"):
        self.spark, self.root, self.accounts, self.as_of = spark, root.rstrip("/"), accounts, as_of
        self.config, self.model, self.scorer, self.provider = config, model, scorer, provider
        self.model_version: int | None = None

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _before(self, name: str, schema: str, number: int) -> DataFrame:
        """State as it was before round ``number``; rounds count from 0, versions from 1."""
        if number == 0 and name != "list":
            return self.spark.createDataFrame([], schema)
        return tables.read_latest(self.spark, self.table(name), schema, number)

    def seed(self, sender_list: DataFrame) -> None:
        tables.write_changes(sender_list.select(*lists.LIST_COLUMNS).distinct(), self.table("list"), 0, list(lists.LIST_COLUMNS))

    def round(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: mail rows (folder INBOX) and feedback rows (feedback folders) together."""
        batch = batch.persist()
        try:
            failed = batch.where("error IS NOT NULL") if "error" in batch.columns else batch.limit(0)
            read = batch.where("error IS NULL") if "error" in batch.columns else batch
            known = self._learn(read, number)
            mail = read.filter(fb.feedback_type(F.col("folder"), self.config).isNull())
            run = jobs.run_detection(
                mail, tables.read_latest(self.spark, self.table("list"), lists.LIST_SCHEMA, number + 1), known, self.model,
                tables.read_latest(self.spark, self.table("history"), fb.HISTORY_SCHEMA, number + 1), self.accounts,
                as_of=self.as_of(), config=self.config, scorer=self.scorer, provider=self.provider, failed=failed)
            self._record(run, known, mail, failed, number)
        finally:
            batch.unpersist()

    def _learn(self, read: DataFrame, number: int) -> DataFrame:
        """What the round's feedback changes; the verdicts on file after it."""
        feedback = fb.from_folders(read, self.config).withColumns({"seq": F.col("msg_id"), "at": F.col("received_at")})
        feedback = jobs.with_fingerprint(feedback)
        before = self._before("list", lists.LIST_SCHEMA, number)
        senders = feedback.select(F.lower(F.coalesce("sender_email", F.lit(""))).alias("sender_email"))
        prior = self.spark.createDataFrame([], fb.HISTORY_SCHEMA) if number == 0 else tables.read_state(
            self.spark, self.table("history"), fb.HISTORY_SCHEMA, number, only=senders)
        learned = jobs.run_feedback(feedback, before, prior, config=self.config)
        columns = list(lists.LIST_COLUMNS)
        tables.write_changes(learned.sender_list.join(before, columns, "left_anti"), self.table("list"), number + 1, columns)
        tables.write_changes(learned.history, self.table("history"), number + 1, ["sender_email"])
        named = learned.samples.withColumn("sample_id", F.concat_ws("-", F.lit(str(number)), "msg_id"))
        tables.write_version(named.select(*training.SAMPLE_COLUMNS), self.table("samples"), number + 1)
        tables.write_version(
            learned.rejected.select("msg_id", "account", "feedback_type", "list_type", "item_type", "raw_item"), self.table("rejects"), number + 1)
        tables.write_version(learned.summary, self.table("feedback_summaries"), number + 1)
        self.retrain_if_due(number)
        self._overrides = learned.overrides
        return verdicts.merge_cache(self._before("cache", tables.CACHE_SCHEMA, number), learned.overrides)

    def _record(self, run: jobs.DetectionRun, known: DataFrame, mail: DataFrame, failed: DataFrame, number: int) -> None:
        began = time.perf_counter()
        tables.write_version(run.decisions, self.table("decisions"), number + 1)
        decided = tables.read_latest(self.spark, self.table("decisions"), version=number + 1)
        each = (time.perf_counter() - began) / max(1, decided.count())
        tables.write_version(jobs.decision_facts(decided, self.as_of(), each), self.table("facts"), number + 1)
        tables.write_version(run.summary, self.table("summaries"), number + 1)
        tables.write_version(failed.select(
            F.col("msg_id").alias("seq"), self.as_of().cast("timestamp_ntz").alias("at"), F.lit("email_processing").alias("error_type"),
            F.col("account")), self.table("errors"), number + 1)
        sure = training.collect_scorer_samples(decided, self.config).join(known.select("fingerprint"), "fingerprint", "left_anti")
        texts = mail.select("msg_id", "sender_email", "sender_domain", "subject", "body")
        samples = texts.join(sure, "msg_id").withColumns({
            "sample_id": F.concat_ws("-", F.lit("scorer"), "fingerprint"), "source": F.lit("scorer")})
        tables.write_version(samples.select(*training.SAMPLE_COLUMNS), self.table("scorer_samples"), number + 1)
        entries = cascade.scorer_cache_entries(decided, self.as_of().cast("timestamp_ntz"))
        tables.write_changes(verdicts.merge_cache(self._overrides, entries), self.table("cache"), number + 1, ["fingerprint"])
        for name in ("list", "history", "cache"):
            tables.compact(self.spark, self.table(name))

    def start(self, mail: DataFrame, available_now: bool = False) -> StreamingQuery:
        writer = mail.writeStream.foreachBatch(self.round).option("checkpointLocation", self.table("checkpoint"))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
            processingTime=f"{self.config.poll_seconds} seconds")
        return writer.start()

    def _all(self, name: str) -> DataFrame:
        return tables.read_committed(self.spark, self.table(name))

    def decisions(self) -> DataFrame:
        """Decisions of all committed rounds."""
        return self._all("decisions").drop("version")

    def samples(self) -> DataFrame:
        """Training samples that feedback of all committed rounds has given."""
        return self._all("samples").drop("version")

    def facts(self) -> DataFrame:
        """Decision facts of all committed rounds, for the statistics."""
        return self._all("facts").drop("version")

    def errors(self) -> DataFrame:
        """Messages of all committed rounds that could not be read."""
        return self._all("errors").drop("version")

    def summaries(self) -> DataFrame:
        """Totals for each account over all committed rounds."""
        rows = self._all("summaries")
        return rows.groupBy("account").agg(*[F.sum(c).alias(c) for c in rows.columns if c not in ("account", "version")])

    #: the pools and how far back a round's training may look: scorer verdicts of the round itself come after it
    POOLS = (("samples", "feedback_upto", 1), ("scorer_samples", "scorer_upto", 0))

    def retrain_if_due(self, number: int) -> None:
        """Take up the newest committed model, then train when a pool has reached the threshold since it was last
        taken in. ``retrains`` records each training: its version, how far it took in each pool, and how it went."""
        done = None
        if tables.latest_version(self.spark, self.table("retrains")) is not None:
            done = self._all("retrains").where(F.col("version") <= number).orderBy(F.desc("version")).first()
        upto = {column: done[column] if done else 0 for _, column, _ in self.POOLS}
        parts, due = [], False
        for pool, column, last in self.POOLS:
            if number + last < 1:
                continue
            rows = self._all(pool).where(F.col("version") <= number + last)
            parts.append(rows.drop("version"))
            fresh = rows.where(F.col("version") > upto[column]).select(F.lit(pool).alias("pool"))
            counted = training.retrain_due(fresh, self.config).first()
            if counted is not None and counted["due"]:
                due, upto[column] = True, number + last
        if due:
            samples = parts[0]
            for part in parts[1:]:
                samples = samples.unionByName(part)
            history = tables.read_latest(self.spark, self.table("history"), fb.HISTORY_SCHEMA, number + 1)
            result, event = jobs.retrain(samples, history, as_of=self.as_of(), config=self.config, model_path=self._model_path(number + 1))
            kept = number + 1 if result.success else done["model"] if done else None
            event = event.withColumns({c: F.lit(v).cast("bigint") for c, v in upto.items()}).withColumn("model", F.lit(kept).cast("bigint"))
            tables.write_version(event, self.table("retrains"), number + 1)
            wanted = kept
        else:
            wanted = done["model"] if done else None
        if wanted is not None and wanted != self.model_version:
            self.model, self.model_version = tables.load_model(self.spark, self._model_path(wanted)), wanted

    def _model_path(self, version: int) -> str:
        return f"{self.table('model')}/version={version:010d}"
