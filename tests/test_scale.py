"""Plans: what is read, what is shuffled, and that one hot key is spread over tasks."""

import re

import pytest
from pyspark.sql import functions as F

from catalog.fixtures import view
from mailsieve.functions import features as ft
from mailsieve.operators import cascade, feedback as fb, lists, training, verdicts
from mailsieve.plans import session

MAIL = ("msg_id bigint, account string, folder string, sender_email string, sender_domain string, subject string, body string, "
        "received_at timestamp_ntz, raw_headers map<string,array<string>>, was_unread boolean")
CACHE = "fingerprint string, action string, reason string, confidence double, method string, override boolean"


def plan(frame, mode="formatted"):
    jvm = frame.sparkSession._jvm
    return frame._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


@pytest.fixture(scope="module")
def stored_mail(spark, tmp_path_factory):
    """A parquet table of mail: a third of all messages are copies from one sender."""
    path = str(tmp_path_factory.mktemp("mail") / "t")
    n = F.col("id")
    who = F.when(n % 3 == 0, F.lit("hot@one.de")).otherwise(F.concat(F.lit("u"), n.cast("string"), F.lit("@many.de")))
    spark.range(30_000).select(
        n.alias("msg_id"), F.lit("p").alias("account"), F.lit("INBOX").alias("folder"), who.alias("sender_email"),
        F.substring_index(who, "@", -1).alias("sender_domain"), F.when(n % 3 == 0, "offer").otherwise(F.concat(F.lit("s"), n.cast("string"))).alias("subject"),
        F.when(n % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), n.cast("string"))).alias("body"),
        F.lit(None).cast("timestamp_ntz").alias("received_at"), F.lit(None).cast("map<string,array<string>>").alias("raw_headers"),
        F.lit(True).alias("was_unread")).write.parquet(path)
    return spark.read.schema(MAIL).parquet(path)


@pytest.fixture
def no_broadcast(spark):
    """Every join by key, and skew handling at the size of the test."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scored(mail):
    return cascade.detection_frame(mail, with_prompt=True).withColumn("p_spam", F.lit(0.6))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_cascade_runs_in_the_jvm_and_never_shuffles_bodies(spark, stored_mail, no_broadcast):
    staged = cascade.stage_verdicts(scored(stored_mail), empty(spark, lists.LIST_SCHEMA), empty(spark, CACHE), cascade.EngineConfig())
    text = plan(staged)
    assert not re.search("EvalPython|InPandas", text)
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    assert exchanges and not any("body#" in e or "_lbody" in e or "subject#" in e for e in exchanges)


def test_only_needed_columns_are_read(stored_mail):
    text = plan(ft.extract_features(stored_mail, groups=("sender", "temporal")))
    assert re.search(r"ReadSchema: struct<msg_id:bigint,sender_email:string,sender_domain:string,received_at:timestamp_ntz>", text)


def test_features_need_no_shuffle(stored_mail):
    text = plan(ft.extract_features(stored_mail))
    assert "Exchange" not in text and not re.search("EvalPython|InPandas", text)


def test_date_condition_of_the_purge_reaches_the_scan(stored_mail):
    from mailsieve.operators import maintenance
    gone = maintenance.old_spam(stored_mail, 10, F.lit("2024-03-01 00:00:00").cast("timestamp"))
    assert "LessThan(received_at,2024-02-20T00:00)" in plan(gone)


def test_hot_sender_is_split(spark, stored_mail, no_broadcast):
    history = spark.range(30_000).select(
        F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@many.de")).alias("sender_email"), F.lit(1).alias("spam_count"),
        F.lit(1).alias("ham_count"), F.lit(None).cast("timestamp_ntz").alias("first_seen"))
    frame = ft.extract_features(stored_mail, history, groups=("sender", "history"))
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    assert "skew=true" in plan(frame, "simple")
    assert frame.filter("sender_total_feedbacks = 2").count() == 20_000


def test_hot_fingerprint_is_combined_before_the_shuffle(spark, stored_mail):
    keyed = stored_mail.select(F.col("msg_id").alias("seq"), F.md5("body").alias("fingerprint"))
    first = verdicts.dedup_decisions(keyed)
    assert "partial_min_by" in plan(first)
    assert first.count() == 20_001
    prompts = keyed.withColumn("prompt", F.col("fingerprint"))
    assert cascade.external_score(prompts, lambda p: ["x"] * len(p)).count() == 20_001


def test_hot_sender_positions_are_sorted_in_buckets(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("hot@one.de").alias("sender_email"),
        F.lit("one.de").alias("sender_domain"), F.lit("is_spam").alias("feedback_type"))
    out = fb.running_counters(rows, bucket_width=1000)
    assert out.filter(F.col("spam_count") != 20_000 - F.col("seq")).count() == 0
    assert re.search(r"Window \[row_number.*_bucket", plan(out, "simple"))


def test_split_is_exact_and_in_ranges(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") < 500).alias("is_spam"))
    parts = {(r.is_spam, r.part): r["count"] for r in training.stratified_split(rows).groupBy("is_spam", "part").count().collect()}
    assert parts == {(True, "test"): 100, (True, "train"): 400, (False, "test"): 900, (False, "train"): 3600}
    assert re.search(r"Window \[row_number.*_bucket", plan(training.stratified_split(rows), "simple"))


def test_one_call_per_fingerprint(spark, stored_mail):
    pending = stored_mail.select(F.md5("body").alias("fingerprint"), F.col("body").alias("prompt"))
    log = spark.sparkContext.accumulator(0)

    def scorer(prompts):
        log.add(len(prompts))
        return ["fine"] * len(prompts)

    cascade.external_score(pending, scorer, concurrency=3).write.format("noop").mode("overwrite").save()
    assert log.value == 20_001


def test_shared_folder_is_the_configured_one(spark):
    class Named:
        class conf:
            get = staticmethod(lambda key, default: {"spark.checkpoint.dir": "hdfs://shared/x/"}.get(key, default))

    assert session.new_path(Named, "stage").startswith("hdfs://shared/x/stage-")
    assert session.shared_folder(spark) == session.shared_folder(spark)


def test_every_message_gets_one_decision(spark, stored_mail):
    out = cascade.classify(scored(stored_mail), empty(spark, lists.LIST_SCHEMA), None, scorer=lambda p: ["ok"] * len(p))
    assert out.count() == 30_000 and out.select("msg_id").distinct().count() == 30_000


def test_conditions_on_list_items_stay_out_of_the_feedback_scan(spark, sf):
    """Pushed back, they repeat the senders' expressions until the generated code no longer compiles."""
    out = fb.apply_feedback(view(spark, sf, "feedback"), view(spark, sf, "sender_list"))
    assert max(len(line) for line in plan(out, "formatted").splitlines()) < 8000


def test_results_of_a_run_read_no_texts_again(spark, stored_mail):
    from mailsieve.plans import jobs
    box = stored_mail.withColumns({"account": F.lit("p"), "folder": F.lit("INBOX"), "was_unread": F.lit(True)})
    accounts = spark.createDataFrame([("p", None)], "name string, spam_folder string")
    run = jobs.run_detection(
        box, empty(spark, lists.LIST_SCHEMA), None, None, None, accounts, as_of=F.lit("2024-03-01 00:00:00").cast("timestamp"),
        config=cascade.EngineConfig(use_scorer_for_uncertain=False))
    assert not any("body" in plan(frame) for frame in (run.decisions, run.summary, run.new_cache_entries))


def test_forest_scores_take_the_features_from_one_table(spark, sf):
    from catalog import learning_queries
    assert "body" not in plan(learning_queries.forest_score(spark, sf))


def test_training_cuts_its_scan_into_small_splits(spark, monkeypatch):
    """While the features are extracted; a size that the session names itself stays."""
    key, seen = session.SPLIT_KEY, []

    class Stop(Exception):
        pass

    def report(parts):
        seen.append(spark.conf.get(key))
        raise Stop

    monkeypatch.setattr(training, "training_report", report)
    rows = spark.range(30).select(
        F.col("id").cast("string").alias("sample_id"), (F.col("id") < 9).alias("is_spam"), F.lit(1.0).alias("weight"))
    for own, during in ((None, "32m"), ("64m", "64m")):
        if own:
            spark.conf.set(key, own)
        before = spark.conf.get(key)
        try:
            with pytest.raises(Stop):
                training.train_forest(rows)
            assert seen.pop() == during and spark.conf.get(key) == before
        finally:
            spark.conf.unset(key)
