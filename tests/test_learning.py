import datetime as dt
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.functions import fixed_values as fv
from mailsieve.operators import feedback as fb
from mailsieve.operators import lists, senders, stats, training
from mailsieve.plans import jobs
from mailsieve.sources import tables
from mailsieve.streaming import jobs as sj

FEEDBACK = "seq bigint, at timestamp_ntz, account string, sender_email string, sender_domain string, feedback_type string, fingerprint string"
T0 = dt.datetime(2024, 1, 1)


def as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def feedback(spark, *rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=i), "p", e, e.split("@")[-1] if "@" in e else "", k, f"f{i}") for i, (e, k) in enumerate(rows)], FEEDBACK)


def random_rows(n, seed):
    """Half of all rows come from one sender."""
    r = random.Random(seed)
    people = ["Big@hot.de", "big@hot.de"] + [f"u{i}@{d}" for i in range(6) for d in ("gmail.com", "x.tk", "x.gq", "y.de")]
    return [(people[0] if r.random() < 0.25 else people[1] if r.random() < 0.3 else r.choice(people[2:]), r.choice(fv.FEEDBACK_TYPES)) for _ in range(n)]


def walk(rows, prior=None, threshold=3, start=()):
    """The row-by-row way: folder by folder, newest first, lists updated as it goes."""
    counts = defaultdict(Counter, {k: Counter(v) for k, v in (prior or {}).items()})
    listed, seen = set(start), {}
    order = sorted(range(len(rows)), key=lambda i: (fv.FEEDBACK_TYPES.index(rows[i][1]), -i))
    for i in order:
        raw, kind = rows[i]
        mail, domain = raw.lower(), raw.split("@")[-1].lower()
        counts[mail][kind] += 1
        c = counts[mail]
        seen[i] = tuple(c[k] for k in fb.COUNTERS)
        white = ("whitelist", "domain", domain) if domain not in fv.MAJOR_PROVIDERS else ("whitelist", "email", mail)

        def black(tlds):
            return ("blacklist", "domain", domain) if domain.endswith(tuple(tlds)) else ("blacklist", "email", mail)

        def free(name):
            return (name, "email", mail) not in listed and (name, "domain", domain) not in listed

        if kind == "whitelist":
            listed.add(white)
        elif kind == "blacklist":
            listed.add(black(fv.BLACKLIST_TLDS))
        elif kind == "not_spam" and c["not_spam"] + c["whitelist"] >= threshold and free("whitelist"):
            listed.add(white)
        elif kind == "is_spam" and c["is_spam"] + c["blacklist"] >= threshold and free("blacklist"):
            listed.add(black(fv.AUTO_BLACKLIST_TLDS))
    return seen, listed, counts


@pytest.mark.parametrize("n, seed", [(12, 1), (60, 2), (300, 3)])
def test_set_based_feedback_equals_the_walk(spark, n, seed):
    rows = random_rows(n, seed)
    frame = feedback(spark, *rows)
    nobody = spark.createDataFrame([("blacklist", "domain", "y.de")], lists.LIST_SCHEMA)
    seen, listed, counts = walk(rows, start={("blacklist", "domain", "y.de")})
    for width in (1_000_000, 7):
        got = {r.seq: tuple(r[c] for c in fb.COUNTERS.values()) for r in fb.running_counters(frame, bucket_width=width).collect()}
        assert got == seen
    assert {tuple(r) for r in fb.apply_feedback(frame, nobody).collect()} == listed
    totals = {r.sender_email: tuple(r[c] for c in fb.COUNTERS.values()) for r in fb.sender_counters(frame).collect()}
    assert totals == {m: tuple(c[k] for k in fb.COUNTERS) for m, c in counts.items()}


def test_prior_state_counts(spark):
    first, second = random_rows(40, 5), random_rows(40, 6)
    nobody = spark.createDataFrame([], lists.LIST_SCHEMA)
    prior = fb.sender_counters(feedback(spark, *first))
    _, listed1, counts1 = walk(first)
    seen2, listed2, _ = walk(second, counts1, start=listed1)
    got = {r.seq: tuple(r[c] for c in fb.COUNTERS.values()) for r in fb.running_counters(feedback(spark, *second), prior).collect()}
    assert got == seen2
    middle = fb.apply_feedback(feedback(spark, *first), nobody)
    assert {tuple(r) for r in fb.apply_feedback(feedback(spark, *second), middle, prior).collect()} == listed2


def test_result_does_not_depend_on_partitioning(spark):
    frame = feedback(spark, *random_rows(200, 9))
    nobody = spark.createDataFrame([], lists.LIST_SCHEMA)
    a = sorted(map(tuple, fb.apply_feedback(frame.repartition(1), nobody).collect()))
    b = sorted(map(tuple, fb.apply_feedback(frame.repartition(13), nobody).collect()))
    assert a == b


def test_invalid_items_are_errors_only(spark):
    rows = feedback(spark, ("broken", "whitelist"), ("broken", "is_spam"), ("ok@x.de", "whitelist"))
    nobody = spark.createDataFrame([], lists.LIST_SCHEMA)
    out = fb.feedback_summary(rows, fb.feedback_rejects(rows, nobody)).first().asDict()
    assert (out["processed"], out["errors"], out["whitelist_added"], out["correction_added"]) == (2, 1, 1, 1)
    assert fb.rejected_targets(rows).count() == 1 and fb.sender_counters(rows).count() == 2


def test_corrections_with_an_invalid_item_are_errors_from_the_threshold_on(spark):
    rows = feedback(spark, *[("broken", "is_spam")] * 6)
    nobody = spark.createDataFrame([], lists.LIST_SCHEMA)
    rejects = fb.feedback_rejects(rows, nobody)
    assert rejects.count() == 4  # the first two are below the threshold of three
    out = fb.feedback_summary(rows, rejects).first().asDict()
    assert (out["processed"], out["errors"], out["correction_added"]) == (2, 4, 2)
    assert fb.feedback_samples(rows).count() == 6 and fb.sender_counters(rows).first()["spam_count"] == 6


def test_a_shared_provider_in_capitals_is_not_listed(spark):
    rows = feedback(spark, *[("u@gmail.com", "not_spam")] * 3, ("u@Gmail.com", "not_spam"))
    got = fb.apply_feedback(rows, spark.createDataFrame([], lists.LIST_SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("whitelist", "email", "u@gmail.com")]


def test_equal_samples_leave_one(spark):
    row = ("s", "a@b.c", "b.c", "t", "x", True, "llm", 1)
    rows = spark.createDataFrame([row] * 3, "sample_id string, sender_email string, sender_domain string, subject string, body string, is_spam boolean, source string, source_rank int")
    assert training.dedup_training(rows).count() == 1


def test_feedback_run(spark):
    run = jobs.run_feedback(feedback(spark, ("a@x.tk", "is_spam"), ("a@x.tk", "is_spam"), ("a@x.tk", "is_spam"), ("a@x.tk", "not_spam")),
                            spark.createDataFrame([], lists.LIST_SCHEMA), None)
    assert [tuple(r) for r in run.sender_list.collect()] == [("blacklist", "domain", "x.tk")]
    assert {(r.action, r.method, r.confidence) for r in run.overrides.collect()} == {("SPAM", "user_feedback", 1.0), ("KEEP", "user_feedback", 1.0)}
    assert run.samples.filter("is_spam").count() == 3


# training

@pytest.fixture(scope="module")
def samples(spark):
    rows = [(f"s{i}", f"u{i}@x.de", "x.de", "WIN CASH!!!" if i % 3 == 0 else f"note {i}", "free prize now" if i % 3 == 0 else "see you at the meeting", i % 3 == 0, None)
            for i in range(60)]
    return spark.createDataFrame(
        rows, "sample_id string, sender_email string, sender_domain string, subject string, body string, is_spam boolean, source string")


SMALL = EngineConfig(num_trees=5, max_depth=4)


def test_training(spark, samples, tmp_path):
    rows = training.weighted_features(samples, as_of=as_of())
    a, b = training.train_forest(rows, SMALL), training.train_forest(rows.repartition(7), SMALL)
    assert a.success and a.accuracy == 1.0 and b.accuracy == 1.0
    assert a.report["samples"] == 60 and a.report["spam"] == 20
    importance = training.feature_importance(a.model, spark).collect()
    assert len(importance) == 79 and importance[0].importance >= importance[1].importance
    tables.save_model(a.model, str(tmp_path / "m"), spark)
    loaded = tables.load_model(spark, str(tmp_path / "m"))
    scored = [{r.sample_id: r.p_spam for r in training.forest_score(rows, m).select("sample_id", "p_spam").collect()} for m in (a.model, loaded)]
    assert scored[0] == scored[1] and scored[0]["s0"] > 0.5 > scored[0]["s1"]


def test_other_features_mean_a_cold_start(spark, samples, tmp_path):
    result = training.train_forest(training.weighted_features(samples, as_of=as_of()), SMALL)
    tables.save_model(result.model, str(tmp_path / "m"), spark)
    spark.createDataFrame([(json.dumps(["old_feature"]),)], "names string").write.mode("overwrite").json(str(tmp_path / "m/features"))
    assert tables.load_model(spark, str(tmp_path / "m")).stages[-1].getNumTrees == 100


def test_too_few_samples(spark, samples):
    result = training.train_forest(training.weighted_features(samples.limit(9), as_of=as_of()), SMALL)
    assert not result.success and "10" in result.error


@pytest.mark.parametrize("label, expected", [(True, 1.0), (False, 0.0)])
def test_one_class(spark, samples, label, expected):
    rows = training.weighted_features(samples.withColumn("is_spam", F.lit(label)), as_of=as_of())
    model = training.train_forest(rows, SMALL).model
    assert {r.p_spam for r in training.forest_score(rows, model).select("p_spam").collect()} == {expected}


def test_no_model(spark, samples):
    assert training.forest_score(samples, None).filter("p_spam IS NOT NULL").count() == 0


def test_default_samples_and_small_split(spark):
    rows = training.default_training_samples(spark)
    assert rows.groupBy("is_spam").count().collect() and rows.filter("is_spam").count() == rows.filter("NOT is_spam").count() == 5
    parts = training.stratified_split(rows)
    assert {r.part for r in parts.collect()} == {"both"}


def test_few_stored_samples_get_the_defaults(spark, samples):
    empty = spark.createDataFrame([], "fingerprint string, action string, method string, override boolean")
    assert training.assemble_training_set(empty, samples.limit(3)).count() == 13
    again = samples.withColumn("sample_id", F.concat(F.lit("t"), "sample_id"))  # sorts after the first ones
    assert {r.sample_id for r in training.assemble_training_set(empty, again.union(samples)).collect()} == {f"s{i}" for i in range(60)}


def test_samples_round_trip(spark, samples, tmp_path):
    path = str(tmp_path / "s")
    tables.append_training_samples(samples.select(F.struct("sender_email", "sender_domain", "subject", "body").alias("email_data"), "is_spam", "source"), path)
    tables.append_training_samples(samples.limit(5).select(F.struct("sender_email").alias("email_data"), "is_spam"), path)
    with open(f"{path}/part-bad.json", "w") as out:
        out.write('{"email_data": {"subject": "x"}, "is_spam": tr\n{"is_spam": true}\n{"email_data": {"text_content": "t"}, "is_spam": true}\n')
    rows = tables.read_training_samples(spark, path)
    assert rows.count() == 66 and rows.filter("body = 't'").count() == 1


def test_retrain(spark, samples, tmp_path):
    result, event = jobs.retrain(samples, None, as_of=as_of(), config=SMALL, model_path=str(tmp_path / "m"))
    assert result.success and stats.retrain_stats(event).first()["ml_retraining_count"] == 1
    assert tables.saved_feature_names(spark, str(tmp_path / "m")) == list(fv.FEATURE_NAMES)


# statistics

def test_empty_statistics(spark):
    none = spark.createDataFrame([], "fingerprint string, seq bigint, decided_at timestamp_ntz, action string, method string, confidence double, processing_time double")
    assert stats.detection_totals(none).first().asDict() == {"total": 0, "spam": 0, "ham": 0, "spam_rate": 0.0}
    assert stats.effectiveness(none).count() == 0 and stats.method_counts(none).count() == 6
    assert stats.avg_processing_time(none).first()[0] == 0.0


def test_merge_and_reset(spark):
    merged = stats.merge_stats(spark.createDataFrame([(1, None)], "total int, spam int"), {"spam": 0, "ham": 7}).first()
    assert merged.asDict() == {"total": 1, "spam": 0, "ham": 7}
    with pytest.raises(ValueError):
        stats.reset_event(as_of())


def test_report(spark, sf, tmp_path):
    from catalog.learning_queries import stats_report
    frame = stats_report(spark, sf)
    doc = json.loads(frame.first()[0])
    assert len(doc["daily_stats"]) == 30 and len(doc["effectiveness"]) == 6
    assert doc["summary"]["total"] == doc["summary"]["spam"] + doc["summary"]["ham"]
    tables.write_report(frame, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 1


def test_recurring_filters(spark):
    past = fb.sender_counters(feedback(spark, *[("a@x.de", "is_spam")] * 3, *[("b@x.de", "not_spam")] * 4, ("c@x.de", "is_spam")))
    rows = senders.recurring_senders(past, as_of()).collect()
    assert [(r.sender_email, r.status, r.days_since_last) for r in rows] == [("b@x.de", ["AUTO-WHITELISTED"], 59), ("a@x.de", ["AUTO-BLACKLISTED"], 59)]
    assert senders.recurring_senders(past, as_of(), spam_only=True, threshold=1).count() == 2
    assert senders.recurring_senders(past, as_of(), ham_only=True, threshold=1, limit=1).count() == 1


# streaming

def test_service_learns_between_rounds(spark, tmp_path):
    schema = ("msg_id bigint, account string, folder string, sender_email string, sender_domain string, subject string, body string, "
              "received_at timestamp_ntz, raw_headers map<string,array<string>>, was_unread boolean")

    def mail(i, folder, sender):
        return (i, "p", folder, sender, sender.split("@")[-1], f"s{i}", "b", T0, None, True)

    accounts = spark.createDataFrame([("p", None)], "name string, spam_folder string")
    service = sj.MailService(spark, str(tmp_path), accounts, as_of=as_of, config=EngineConfig(use_scorer_for_uncertain=False))
    service.seed(spark.createDataFrame([], lists.LIST_SCHEMA))
    service.round(spark.createDataFrame([mail(1, "INBOX", "a@x.tk"), mail(2, "FEEDBACK_IS_SPAM", "a@x.tk"), mail(3, "FEEDBACK_IS_SPAM", "a@x.tk")], schema), 0)
    second = spark.createDataFrame([mail(4, "FEEDBACK_IS_SPAM", "a@x.tk"), mail(5, "INBOX", "a@x.tk"), mail(6, "INBOX", "b@y.de")], schema)
    service.round(second, 1)
    service.round(second, 1)  # repeated after a failure: same result
    got = sorted((r.msg_id, r.action, r.method) for r in service.decisions().collect())
    assert got == [(1, "KEEP", "default"), (5, "SPAM", "blacklist"), (6, "KEEP", "default")]
    assert tables.read_latest(spark, service.table("history"), fb.HISTORY_SCHEMA).first()["spam_count"] == 3
    assert tables.read_latest(spark, service.table("cache"), tables.CACHE_SCHEMA).count() == 3


def test_rounds_leave_samples_facts_and_a_new_model(spark, tmp_path):
    schema = ("msg_id bigint, account string, folder string, sender_email string, sender_domain string, subject string, body string, "
              "received_at timestamp_ntz, raw_headers map<string,array<string>>, was_unread boolean")
    rows = [(i, "p", "FEEDBACK_IS_SPAM" if i % 2 else "FEEDBACK_NOT_SPAM", f"u{i}@{'win.tk' if i % 2 else 'y.de'}", "win.tk" if i % 2 else "y.de",
             f"FREE PRIZE {i}!!!" if i % 2 else f"minutes {i}", "claim your free cash now http://a.tk" if i % 2 else "see you at ten", T0, None, True) for i in range(30)]
    rows.append((99, "p", "INBOX", "n@z.de", "z.de", "minutes", "see you at noon", T0, None, True))
    accounts = spark.createDataFrame([("p", None)], "name string, spam_folder string")
    config = EngineConfig(use_scorer_for_uncertain=False, num_trees=5, max_depth=3)
    service = sj.MailService(spark, str(tmp_path), accounts, as_of=as_of, config=config)
    service.seed(spark.createDataFrame([], lists.LIST_SCHEMA))
    service.round(spark.createDataFrame(rows, schema), 0)
    assert service.samples().count() == 30 and service.model is not None
    assert tables.read_latest(spark, service.table("retrains"), version=1).first()["success"]
    assert service.decisions().first()["p_spam"] is not None
    assert service.facts().count() == 1 and stats.avg_processing_time(service.facts()).first()[0] > 0


def test_update_mode_keeps_every_sender_over_batches_and_restarts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "seq bigint, at timestamp_ntz, account string, sender_email string, sender_domain string, feedback_type string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def add(*names):
        spark.createDataFrame([(i, T0, "p", n, n.split("@")[1], "is_spam") for i, n in enumerate(names)], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        sj.start_to_table(sj.sender_counter_stream(stream), out, "update", available_now=True, keys=("sender_email",)).awaitTermination()
        return {r.sender_email: r.spam_count for r in tables.read_latest(spark, out).collect()}

    add("a@x.de", "a@x.de")
    add("b@x.de")
    add("c@x.de", "a@x.de")
    assert run() == {"a@x.de": 3, "b@x.de": 1, "c@x.de": 1}
    add("b@x.de")
    assert run() == {"a@x.de": 3, "b@x.de": 2, "c@x.de": 1}


def test_a_restarted_append_stream_goes_on(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "fingerprint string, decided_at timestamp_ntz, action string"
    for name in ("f1", "f2"):
        spark.createDataFrame([(name, T0, "SPAM")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sj.start_to_table(sj.dedup_stream(stream), out, available_now=True).awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(out).collect()) == ["f1", "f2"]


def test_uncommitted_versions_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    tables.write_version(spark.range(3), root, 1)
    spark.range(5).write.parquet(tables.version_path(root, 2))
    assert tables.read_committed(spark, root).count() == 3


def test_late_rows_and_duplicates(spark, tmp_path):
    schema = "fingerprint string, decided_at timestamp_ntz, action string"
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def add(_, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    day = dt.datetime(2024, 1, 10)
    add("a", ("f1", day, "SPAM"), ("f1", day, "SPAM"))
    add("b", ("f2", day + dt.timedelta(days=5), "KEEP"))
    add("b", ("f5", day + dt.timedelta(days=5), "KEEP"))  # lateness counts from the batch before last
    add("c", ("f3", day, "SPAM"), ("f2", day + dt.timedelta(days=5), "KEEP"))
    add("d", ("f4", day + dt.timedelta(days=12), "KEEP"))
    out, daily = str(tmp_path / "dedup"), str(tmp_path / "daily")
    sj.start_to_table(sj.dedup_stream(stream), out, available_now=True).awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(out).collect()) == ["f1", "f2", "f3", "f4", "f5"]
    sj.start_to_table(sj.daily_stats_stream(stream), daily, available_now=True).awaitTermination()
    got = {str(r.day): r.emails_processed for r in spark.read.parquet(daily).collect()}
    assert got["2024-01-10"] == 2 and got["2024-01-15"] == 3  # the row that came five days late is left out
