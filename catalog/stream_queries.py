"""Streaming operators run to the end of their input; results must equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.feature_queries import as_of
from catalog.fixtures import VIEWS, as_engine_messages, load_tables, view, with_views
from catalog.learning_queries import _COUNTED, _FB, _HISTORY, _RANK
from mailsieve.config import EngineConfig
from mailsieve.functions import fixed_values as fv
from mailsieve.operators import feedback as fb
from mailsieve.operators import lists
from mailsieve.plans.session import new_path
from mailsieve.sources import tables
from mailsieve.streaming import jobs as sj
from mailsieve.streaming import state

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def stream_view(spark: SparkSession, sf: str, source: str, name: str) -> DataFrame:
    """A fixture view over a table that is read as a stream, whether it is one file or a folder of files."""
    load_tables(spark, sf)
    static = spark.read.parquet(f"{sf}/{source}.parquet")
    live = spark.readStream.schema(static.schema).parquet(f"{sf}/{source}.parque[t]")  # a stream takes one file only by a pattern
    live.createOrReplaceTempView(f"{source}_live")
    needs, sql = VIEWS[name]
    texts = [(n, VIEWS[n][1]) for n in needs] + [(name, sql)]
    ctes = ", ".join(f"{n} AS ({t.replace(f'FROM {source}', f'FROM {source}_live')})" for n, t in texts)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@query(with_views("decisions") + "SELECT DISTINCT fingerprint FROM decisions")
def dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = stream_view(spark, sf, "events", "decisions")
    path = new_path(spark, "dedup")
    _finish(sj.start_to_table(sj.dedup_stream(rows), path, available_now=True))
    return spark.read.parquet(path).select("fingerprint")


@query(_FB + f", {_HISTORY} SELECT sender_email, spam_count, ham_count, whitelist_count, blacklist_count FROM history")
def sender_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_totals(spark, sf).select("sender_email", *fb.COUNTERS.values())


def _stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "senders")
    totals = sj.sender_counter_stream(stream_view(spark, sf, "events", "feedback"))
    _finish(sj.start_to_table(totals, path, "update", available_now=True, keys=("sender_email",)))
    return tables.read_latest(spark, path, fb.HISTORY_SCHEMA)


@query(_FB + f""", {_HISTORY} SELECT sender_email, 'blacklist' AS list_type FROM history WHERE spam_count > 0 AND spam_count + blacklist_count >= 3
  UNION ALL SELECT sender_email, 'whitelist' AS list_type FROM history WHERE ham_count > 0 AND ham_count + whitelist_count >= 3""")
def auto_list_events_stream(spark: SparkSession, sf: str) -> DataFrame:
    return sj.auto_list_events(_stream_totals(spark, sf)).select("sender_email", "list_type")


@query(with_views("decisions") + """SELECT strftime(CAST(decided_at AS DATE), '%Y-%m-%d') AS day, count(*) AS emails_processed,
  count(*) FILTER (action = 'SPAM') AS spam_detected, count(*) FILTER (action <> 'SPAM') AS ham_detected FROM decisions GROUP BY 1""")
def daily_stats_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "daily")
    daily = sj.daily_stats_stream(stream_view(spark, sf, "events", "decisions"), "60 days")
    _finish(sj.start_to_table(daily, path, "complete", available_now=True))
    out = tables.read_latest(spark, path, "day date, emails_processed bigint, spam_detected bigint, ham_detected bigint")
    return out.withColumn("day", F.col("day").cast("string"))


@query(with_views("messages") + """SELECT msg_id, CASE WHEN sender_domain = 'company.com' OR sender_email IN ('user8@gmail.com', 'user3@lottery.tk') THEN 'KEEP'
    WHEN sender_domain = 'lottery.tk' OR sender_email = 'user7@promo.click' THEN 'SPAM' ELSE 'KEEP' END AS action,
  CASE WHEN sender_domain = 'company.com' OR sender_email IN ('user8@gmail.com', 'user3@lottery.tk') THEN 'whitelist'
    WHEN sender_domain = 'lottery.tk' OR sender_email = 'user7@promo.click' THEN 'blacklist' ELSE 'llm_openai' END AS method
  FROM messages WHERE was_unread""")
def classify_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The polling service over the message stream: no model, a scorer that knows nothing."""
    mail = as_engine_messages(stream_view(spark, sf, "documents", "messages"))
    service = sj.MailService(
        spark, new_path(spark, "service"), view(spark, sf, "accounts"), as_of=as_of, config=EngineConfig(),
        scorer=lambda prompts: ['{"is_spam":false}'] * len(prompts))
    service.seed(view(spark, sf, "sender_list"))
    _finish(service.start(mail, available_now=True))
    return service.decisions().select("msg_id", "action", "method")


@query(with_views("messages", "sender_list") + """SELECT item_type, count(*) AS items FROM sender_list WHERE list_type = 'blacklist' GROUP BY 1""")
def list_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The list a later round sees: the version written by the last one."""
    mail = as_engine_messages(stream_view(spark, sf, "documents", "messages")).withColumn(
        "folder", F.when(F.col("sender_domain") == "example.com", "FEEDBACK_WHITELIST").otherwise("INBOX"))
    service = sj.MailService(spark, new_path(spark, "service"), view(spark, sf, "accounts"), as_of=as_of,
                             config=EngineConfig(use_scorer_for_uncertain=False))
    service.seed(view(spark, sf, "sender_list"))
    _finish(service.start(mail, available_now=True))
    latest = tables.read_latest(spark, service.table("list"), lists.LIST_SCHEMA)
    return latest.filter("list_type = 'blacklist'").groupBy("item_type").agg(F.count("*").alias("items"))


_RUNS, _FILES = 6, 4


def _feedback_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The feedback as a stream of ``_RUNS`` micro-batches: every sixth row in the first, and so on."""
    path = new_path(spark, "feedback")
    rows = view(spark, sf, "feedback").withColumn("run", F.col("seq") % _RUNS)
    for run in range(_RUNS):
        rows.where(F.col("run") == run).repartition(_FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _FILES).parquet(path)


def _totals_log(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "totals")
    writer = _feedback_runs(spark, sf).writeStream.foreachBatch(state.sender_totals_round(root))
    _finish(writer.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    return state.totals_log(spark, root)


@query(_FB + f", {_HISTORY} SELECT sender_email, sender_domain, spam_count, ham_count, whitelist_count, blacklist_count FROM history")
def sender_state_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Totals kept as state over six micro-batches."""
    return state.latest_totals(_totals_log(spark, sf)).select("sender_email", "sender_domain", *fb.COUNTERS.values())


@query(_FB + f""", per_run AS (SELECT lower(sender_email) AS sender_email, seq % {_RUNS} AS run, {_COUNTED} FROM feedback GROUP BY 1, 2),
so_far AS (SELECT sender_email, run, spam_count AS new_spam, ham_count AS new_ham,
  sum(spam_count + blacklist_count) OVER w AS spam, sum(ham_count + whitelist_count) OVER w AS ham
  FROM per_run WINDOW w AS (PARTITION BY sender_email ORDER BY run))
SELECT sender_email, 'blacklist' AS list_type, min(run) AS run FROM so_far WHERE new_spam > 0 AND spam >= 3 GROUP BY 1
UNION ALL SELECT sender_email, 'whitelist' AS list_type, min(run) AS run FROM so_far WHERE new_ham > 0 AND ham >= 3 GROUP BY 1""")
def auto_list_events_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batch in which each sender comes onto a list, once."""
    return state.list_events(_totals_log(spark, sf)).select("sender_email", "list_type", "run")


@query(_FB + f"""SELECT seq, count(*) FILTER (feedback_type = 'is_spam') OVER w AS spam_count, count(*) FILTER (feedback_type = 'not_spam') OVER w AS ham_count,
  count(*) FILTER (feedback_type = 'whitelist') OVER w AS whitelist_count, count(*) FILTER (feedback_type = 'blacklist') OVER w AS blacklist_count
  FROM feedback WINDOW w AS (PARTITION BY lower(sender_email) ORDER BY seq % {_RUNS}, {_RANK}, seq DESC ROWS UNBOUNDED PRECEDING)""")
def running_counters_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each feedback with its sender's counters, which go on from batch to batch."""
    root = new_path(spark, "running")
    writer = _feedback_runs(spark, sf).writeStream.foreachBatch(state.running_counter_round(root))
    _finish(writer.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    return tables.read_committed(spark, f"{root}/running").select("seq", *fb.COUNTERS.values())


@query(with_views("decisions") + """SELECT coalesce(round(avg(processing_time), 3), 0.0) AS avg_processing_time
  FROM (SELECT processing_time FROM decisions WHERE processing_time > 0 ORDER BY seq DESC LIMIT 1000)""")
def avg_processing_time_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of the last 1,000 times, kept over micro-batches of mixed numbers."""
    path, root = new_path(spark, "decisions"), new_path(spark, "times")
    rows = view(spark, sf, "decisions")
    rows.repartition(_RUNS * _FILES).write.parquet(path)
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _FILES).parquet(path)
    writer = live.writeStream.foreachBatch(state.recent_times_round(root))
    _finish(writer.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    return state.recent_average(spark, root)


_COUNTED_METHODS = ", ".join(f"'{m}'" for m in fv.COUNTED_METHODS)


@query(with_views("decisions", "feedback", "error_events") + f""", closed AS (
  SELECT least((SELECT max(decided_at) FROM decisions), (SELECT max(feedback.at) FROM feedback), (SELECT max(error_events.at) FROM error_events)) - INTERVAL '2' DAY AS upto),
per_method AS (SELECT CAST(decided_at AS DATE) AS day, method, count(*) AS n, count(*) FILTER (action = 'SPAM') AS s FROM decisions GROUP BY 1, 2),
decided AS (SELECT day, sum(n) AS n, sum(s) AS s, coalesce(string_agg(method || '=' || n, ',' ORDER BY method) FILTER (method IN ({_COUNTED_METHODS})), '') AS methods
  FROM per_method GROUP BY 1),
fed AS (SELECT CAST(feedback.at AS DATE) AS day, count(*) AS n FROM feedback GROUP BY 1),
failed AS (SELECT CAST(error_events.at AS DATE) AS day, count(*) AS n FROM error_events GROUP BY 1),
days AS (SELECT day FROM decided UNION SELECT day FROM fed UNION SELECT day FROM failed)
SELECT strftime(days.day, '%Y-%m-%d') AS day, CAST(coalesce(d.n, 0) AS BIGINT) AS emails_processed, CAST(coalesce(d.s, 0) AS BIGINT) AS spam_detected,
  CAST(coalesce(d.n - d.s, 0) AS BIGINT) AS ham_detected, coalesce(f.n, 0) AS feedback_processed, coalesce(e.n, 0) AS errors, coalesce(methods, '') AS methods
FROM days LEFT JOIN decided d ON d.day = days.day LEFT JOIN fed f ON f.day = days.day LEFT JOIN failed e ON e.day = days.day, closed
WHERE days.day + INTERVAL '1' DAY <= closed.upto""")
def closed_days_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Three streams; each day comes once, when all of them have passed it by two days."""
    path = new_path(spark, "days")
    streams = [stream_view(spark, sf, "events", name) for name in ("decisions", "feedback", "error_events")]
    _finish(sj.start_to_table(state.closed_days_stream(*streams), path, available_now=True))
    methods = F.array_join(F.transform(F.map_entries("methods_used"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return spark.read.parquet(path).select(
        F.col("day").cast("string").alias("day"), *[F.col(c) for c in ("emails_processed", "spam_detected", "ham_detected", "feedback_processed", "errors")],
        methods.alias("methods"))


_FED = "sender_domain = 'example.com' AND msg_id % 3 = 0"


@query(with_views("messages") + f"""SELECT msg_id, CASE WHEN sender_domain IN ('company.com', 'example.com') OR sender_email IN ('user8@gmail.com', 'user3@lottery.tk')
    THEN 'KEEP' ELSE 'SPAM' END AS action,
  CASE WHEN sender_domain IN ('company.com', 'example.com') OR sender_email IN ('user8@gmail.com', 'user3@lottery.tk')
    THEN 'whitelist' ELSE 'blacklist' END AS method
  FROM messages WHERE was_unread AND NOT ({_FED}) AND EXISTS (SELECT 1 FROM messages WHERE {_FED}) AND
    (sender_domain IN ('company.com', 'example.com', 'lottery.tk') OR sender_email IN ('user8@gmail.com', 'user3@lottery.tk', 'user7@promo.click'))""")
def list_refresh_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of the service: feedback of the first puts a domain onto the whitelist, which decides mail of the second."""
    mail = view(spark, sf, "messages")
    service = sj.MailService(spark, new_path(spark, "service"), view(spark, sf, "accounts"), as_of=as_of,
                             config=EngineConfig(use_scorer_for_uncertain=False))
    service.seed(view(spark, sf, "sender_list"))
    service.round(mail.where(_FED).withColumn("folder", F.lit("FEEDBACK_WHITELIST")), 0)
    service.round(mail.where(f"NOT ({_FED})"), 1)
    return service.decisions().where("method IN ('whitelist', 'blacklist')").select("msg_id", "action", "method")
