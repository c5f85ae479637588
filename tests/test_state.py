"""Keyed change tables and the state of streams, over many batches and restarts."""

from __future__ import annotations

import collections
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.operators import feedback as fb
from mailsieve.operators import stats
from mailsieve.sources import tables
from mailsieve.streaming import state

T0 = dt.datetime(2024, 1, 1)
KEYED = "k string, n bigint"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def as_dict(frame):
    return {r.k: r.n for r in frame.collect()}


def test_change_rows_fold_delete_and_repeat(spark, tmp_path):
    root = str(tmp_path / "t")
    put = lambda rows, v, **kw: tables.write_changes(spark.createDataFrame(rows, kw.get("schema", KEYED)), root, v, ["k"])
    assert tables.read_latest(spark, root, KEYED).collect() == [] and not tables.compact(spark, root)
    put([("a", 1), ("b", 1)], 1)
    put([("b", 2), (None, 7)], 2)
    put([("a", None, True)], 3, schema=KEYED + ", _deleted boolean")
    assert as_dict(tables.read_latest(spark, root)) == {"b": 2, None: 7}
    assert as_dict(tables.read_latest(spark, root, version=1)) == {"a": 1, "b": 1}
    assert as_dict(tables.read_state(spark, root, only=spark.createDataFrame([("b", 0)], KEYED))) == {"b": 2}
    assert tables.compact(spark, root, every=3) and not tables.compact(spark, root, every=3)
    before = as_dict(tables.read_latest(spark, root))
    put([("a", None, True)], 3, schema=KEYED + ", _deleted boolean")  # the round is repeated after the snapshot
    assert as_dict(tables.read_latest(spark, root)) == before and tables.snapshots(spark, root) == []
    put([("c", 3)], 4)
    assert as_dict(tables.read_latest(spark, root)) == before | {"c": 3}


def test_a_round_writes_what_it_changes_and_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_changes(spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.col("id").alias("n")), root, 0, ["k"])
    whole = size(tables.version_path(root, 0))
    for v in range(1, 10):
        tables.write_changes(spark.createDataFrame([(f"x{v % 3}", v)], KEYED), root, v, ["k"])
        assert size(tables.version_path(root, v)) < whole / 100
        assert tables.compact(spark, root, every=3) == (v in (2, 5, 8))
    assert tables.snapshots(spark, root) == [5, 8]
    assert sorted(os.listdir(f"{root}/data")) == [f"version={v:010d}" for v in (6, 7, 8, 9)]
    assert tables.read_latest(spark, root).count() == 50_003
    assert as_dict(tables.read_latest(spark, root).where("k LIKE 'x%'")) == {"x0": 9, "x1": 7, "x2": 8}
    assert as_dict(tables.read_latest(spark, root, version=6).where("k LIKE 'x%'")) == {"x0": 6, "x1": 4, "x2": 5}
    with pytest.raises(LookupError):
        tables.read_latest(spark, root, version=4)


def test_a_lost_snapshot_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    for v in range(1, 4):
        tables.write_changes(spark.createDataFrame([("a", v)], KEYED), root, v, ["k"])
    assert tables.compact(spark, root, every=3)
    os.remove(f"{tables.snapshot_path(root, 3)}/_SUCCESS")
    assert tables.snapshots(spark, root) == [] and as_dict(tables.read_latest(spark, root)) == {"a": 3}


FEEDBACK = "seq bigint, at timestamp_ntz, account string, sender_email string, sender_domain string, feedback_type string, run bigint"


def feedback_rows():
    kinds = ["whitelist", "blacklist", "not_spam", "is_spam"]
    rows = []
    for i in range(160):
        sender = "Hot@x.tk" if i % 3 == 0 else f"u{i % 9}@{'gmail.com' if i % 2 else 'y.de'}"
        rows.append((i, T0 + dt.timedelta(hours=i), "p", None if i == 77 else sender, None if i % 40 == 5 else sender.split("@")[1].upper(), kinds[(i * 7 + i // 9) % 4], i // 20))
    return rows


def feed(spark, folder, rows):
    spark.createDataFrame(rows, FEEDBACK).coalesce(1).write.mode("append").parquet(folder)


def run_totals(spark, source, out):
    stream = spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).parquet(source)
    log = state.sender_totals_stream(stream)
    query = log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/_c").trigger(availableNow=True).start(f"{out}/log")
    try:
        assert query.awaitTermination(120) and query.exception() is None
    finally:
        query.stop()
    return spark.read.parquet(f"{out}/log")


def walked(rows, limit=3):
    """(run, sender, list) of each event, by a walk over the runs."""
    totals, sent, out = collections.defaultdict(collections.Counter), set(), []
    for run in sorted({r[6] for r in rows}):
        now = collections.defaultdict(collections.Counter)
        for r in rows:
            if r[6] == run:
                now[(r[3] or "").lower()][r[5]] += 1
        for sender, new in now.items():
            totals[sender] += new
            t = totals[sender]
            for kind, explicit, name in (("is_spam", "blacklist", "blacklist"), ("not_spam", "whitelist", "whitelist")):
                if new[kind] and t[kind] + t[explicit] >= limit and (sender, name) not in sent:
                    sent.add((sender, name))
                    out.append((run, sender, name))
    return sorted(out)


def test_list_events_come_once_over_batches_and_restarts(spark, tmp_path):
    rows, source, out = feedback_rows(), str(tmp_path / "in"), str(tmp_path / "out")
    for run in range(4):
        feed(spark, source, [r for r in rows if r[6] == run])
    run_totals(spark, source, out)
    for run in range(4, 8):
        feed(spark, source, [r for r in rows if r[6] == run])
    log = run_totals(spark, source, out)  # started again
    events = state.list_events(log).collect()
    assert sorted((r.run, r.sender_email, r.list_type) for r in events) == walked(rows)
    assert {(r.list_type, r.item_type, r.raw_item) for r in events if r.sender_email == "hot@x.tk"} == {
        (name, "domain", "x.tk") for _, sender, name in walked(rows) if sender == "hot@x.tk"} != set()
    want = fb.sender_counters(spark.createDataFrame(rows, FEEDBACK))
    assert sorted(map(str, state.latest_totals(log).collect())) == sorted(map(str, want.select(*state.latest_totals(log).columns).collect()))


def test_totals_with_a_time_to_live(spark, tmp_path):
    """A stream with a time to live has batches without data, so it is stopped rather than run to an end."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, source, feedback_rows())
    stream = spark.readStream.schema(FEEDBACK).parquet(source)
    query = state.sender_totals_stream(stream, ttl_days=365).writeStream.format("memory").queryName("ttl_totals").outputMode("append").option(
        "checkpointLocation", f"{out}/_c").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if query.awaitTermination(1) or spark.table("ttl_totals").count():
                break
        assert sorted((r.sender_email, r.list_type) for r in state.list_events(spark.table("ttl_totals")).collect()) == [
            e[1:] for e in walked([(*r[:6], 0) for r in feedback_rows()])]
    finally:
        query.stop()


def test_running_counters_over_batches_equal_one_walk(spark, tmp_path):
    rows, root = feedback_rows(), str(tmp_path / "r")
    batches = [[r for r in rows if r[6] == run] for run in range(8)]
    one = state.running_counter_round(root)
    for number, batch in enumerate(batches):
        one(spark.createDataFrame(batch, FEEDBACK), number)
        if number == 3:
            one(spark.createDataFrame(batch, FEEDBACK), number)  # repeated
    rank = {"whitelist": 0, "blacklist": 1, "not_spam": 2, "is_spam": 3}
    totals, want = collections.defaultdict(collections.Counter), {}
    for seq, _, _, sender, _, kind, _ in sorted(rows, key=lambda r: (r[6], rank[r[5]], -r[0])):
        totals[(sender or "").lower()][kind] += 1
        t = totals[(sender or "").lower()]
        want[seq] = (t["is_spam"], t["not_spam"], t["whitelist"], t["blacklist"])
    got = tables.read_committed(spark, f"{root}/running").collect()
    assert {r.seq: (r.spam_count, r.ham_count, r.whitelist_count, r.blacklist_count) for r in got} == want and len(got) == len(rows)


def test_closed_days_equal_daily_stats_and_late_rows_are_named(spark, tmp_path):
    D = "decided_at timestamp_ntz, action string, method string"
    A = "at timestamp_ntz"
    at = lambda day, hour=0: T0 + dt.timedelta(days=day, hours=hour)
    batches = [
        ([(at(d, h), "SPAM" if h % 2 else "KEEP", ["whitelist", "default", "other"][h % 3]) for d in range(3) for h in range(5)], [(at(0, 1),), (at(2, 3),)], [(at(1, 2),)]),
        ([(at(d, 1), "KEEP", "blacklist") for d in (1, 5, 6)], [(at(6),)], [(at(6),)]),
        ([(at(0, 2), "SPAM", "whitelist"), (at(9), "KEEP", "default")], [(at(9),), (at(1, 9),)], [(at(9),)]),
    ]
    streams = []
    for name, schema in (("d", D), ("f", A), ("e", A)):
        (tmp_path / name).mkdir()
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    out = str(tmp_path / "out")
    for batch in batches:
        for name, schema, rows in zip("dfe", (D, A, A), batch):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        days = state.closed_days_stream(*streams, lateness="2 days")
        days.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/_c").trigger(availableNow=True).start(f"{out}/days").awaitTermination(120)
    decisions, feedback, errors = (spark.read.schema(s).parquet(str(tmp_path / n)) for n, s in zip("dfe", (D, A, A)))
    closed = spark.read.parquet(f"{out}/days")
    found = {r.day: r for r in closed.collect()}
    # at the end the least of the three greatest times is day 9, so days that end by day 7 are closed
    assert sorted(found) == [at(d).date() for d in (0, 1, 2, 5, 6)] and closed.count() == 5
    late = {r.day: (r.late_decisions, r.late_feedback, r.late_errors) for r in state.late_rows(closed, decisions, feedback, errors).collect()}
    assert late == {at(0).date(): (1, 0, 0), at(1).date(): (0, 1, 0)}
    whole = stats.daily_stats(decisions, feedback, errors, 30, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    for r in whole.collect():
        if r.day in found and r.day not in late:
            assert found[r.day].asDict() == r.asDict()
    assert EngineConfig().auto_blacklist_threshold == 3


MAIL = ("msg_id bigint, account string, folder string, sender_email string, sender_domain string, subject string, body string, "
        "received_at timestamp_ntz, raw_headers map<string,array<string>>, was_unread boolean, error string")


def service_of(spark, root, **kw):
    from mailsieve.streaming import jobs as sj

    accounts = spark.createDataFrame([("p", None)], "name string, spam_folder string")
    config = EngineConfig(num_trees=5, max_depth=3, retrain_threshold=6, min_training_samples=4, marketing_confidence_threshold=2.0, ml_confidence_threshold=0.99)
    return sj.MailService(spark, root, accounts, as_of=lambda: F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), config=config, **kw)


def test_scorer_verdicts_of_several_rounds_train_a_model_that_a_new_service_takes_up(spark, tmp_path):
    def mail(i, folder="INBOX", error=None):
        spam = i % 2 == 1
        return (i, "p", folder, f"u{i}@{'win.tk' if spam else 'y.de'}", "win.tk" if spam else "y.de", f"FREE PRIZE {i}" if spam else f"minutes {i}",
                "claim your free cash" if spam else "see you at ten", T0, None, True, error)

    def scorer(prompts):
        return ['{"is_spam":%s,"confidence":%s}' % (("true", 0.9) if "FREE" in p else ("false", 0.8)) for p in prompts]

    root = str(tmp_path)
    service = service_of(spark, root, scorer=scorer)
    service.seed(spark.createDataFrame([], "list_type string, item_type string, item string"))
    service.round(spark.createDataFrame([mail(i) for i in range(1, 5)] + [mail(90, error="broken")], MAIL), 0)
    service.round(spark.createDataFrame([mail(i) for i in range(5, 9)] + [mail(1)], MAIL), 1)
    assert service.model is None
    assert service._all("scorer_samples").count() == 8  # the message that comes again has a verdict on file
    whitelisted = [mail(20, "FEEDBACK_WHITELIST"), mail(11, "FEEDBACK_NOT_SPAM")]
    service.round(spark.createDataFrame(whitelisted, MAIL), 2)  # eight verdicts wait: due
    assert service.model_version == 3
    record = tables.read_latest(spark, service.table("retrains"), version=3).first()
    assert record.success and (record.feedback_upto, record.scorer_upto, record.model) == (0, 2, 3)
    errors = {r.account: (r.processed, r.errors) for r in service.summaries().collect()}
    assert errors == {"p": (9, 1)} and service.errors().count() == 1

    again = service_of(spark, root)  # started anew, without a scorer
    again.round(spark.createDataFrame([mail(22)], MAIL), 3)
    assert again.model_version == 3
    assert tables.latest_version(spark, again.table("retrains")) == 3
    last = again.decisions().where("msg_id = 22").first()
    assert last.p_spam is not None and last.method == "whitelist"  # the domain y.de came onto the list in round 2
    service.round(spark.createDataFrame(whitelisted, MAIL), 2)  # repeated after a failure
    assert tables.read_latest(spark, service.table("history")).agg(F.sum("whitelist_count"), F.sum("ham_count")).first()[:] == (1, 1)


def test_training_knows_the_senders_history(spark, tmp_path):
    """Samples of senders with corrections get the weight of their history."""
    from mailsieve.operators import training

    history = spark.createDataFrame([("a@x.tk", "x.tk", 9, 0, 0, 0, T0, T0)], fb.HISTORY_SCHEMA)
    samples = spark.createDataFrame([("1", "a@x.tk", "x.tk", "s", "b", True, "user_feedback")], "sample_id string, sender_email string, sender_domain string, subject string, body string, is_spam boolean, source string")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    with_history, without = (training.weighted_features(samples, h, as_of=at).first() for h in (history, None))
    assert with_history["weight"] >= without["weight"] and with_history.asDict() != without.asDict()


def test_recent_times_equal_the_batch_mean_after_any_batching(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS seq", "IF(id % 7 = 0, -1.0, id % 113 + 0.5) AS processing_time").union(
        spark.createDataFrame([(None, 5.0), (5000, None)], "seq long, processing_time double"))
    want = stats.avg_processing_time(rows.where("seq IS NOT NULL")).collect()
    for parts in (1, 4):
        root = str(tmp_path / f"r{parts}")
        step = state.recent_times_round(root)
        for number, part in enumerate(rows.randomSplit([1.0] * parts, 3)):
            step(part, number)
            step(part, number)  # a repeated batch changes nothing
        assert state.recent_average(spark, root).collect() == want
        assert tables.read_latest(spark, root).count() == 1000
    assert state.recent_average(spark, str(tmp_path / "none")).first()[0] == 0.0


def test_streams_read_a_table_of_many_files(spark, sf, tmp_path):
    from catalog.fixtures import TABLES
    from catalog.stream_queries import classify_stream, dedup_stream
    for name in TABLES:
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet") if name not in ("documents", "events") else (
            spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet")))
    got = classify_stream(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, classify_stream(spark, sf).collect())) != []
    assert dedup_stream(spark, str(tmp_path)).count() == dedup_stream(spark, sf).count() > 0


def test_totals_by_rounds_equal_the_state_operator_and_repeat(spark, tmp_path):
    rows, root = feedback_rows(), str(tmp_path / "rounds")
    one = state.sender_totals_round(root)
    for run in range(8):
        batch = spark.createDataFrame([r for r in rows if r[6] == run], FEEDBACK)
        one(batch, run)
        if run in (0, 5):
            one(batch, run)  # repeated after a failure
    log = state.totals_log(spark, root)
    assert sorted((r.run, r.sender_email, r.list_type) for r in state.list_events(log).collect()) == walked(rows)
    want = fb.sender_counters(spark.createDataFrame(rows, FEEDBACK))
    assert sorted(map(str, state.latest_totals(log).collect())) == sorted(map(str, want.select(*state.latest_totals(log).columns).collect()))


def test_the_totals_of_many_senders_call_no_python(spark, tmp_path):
    from catalog import stream_queries
    assert "sender_totals_round" in stream_queries._totals_log.__code__.co_names
    rows = spark.range(40_000).selectExpr(
        "id AS seq", "timestamp_ntz'2024-01-01' AS at", "'p' AS account", "concat('u', id DIV 4, '@x.de') AS sender_email",
        "'x.de' AS sender_domain", "'is_spam' AS feedback_type", "0L AS run")
    state.sender_totals_round(str(tmp_path / "t"))(rows, 0)
    assert state.list_events(state.totals_log(spark, str(tmp_path / "t"))).count() == 10_000
