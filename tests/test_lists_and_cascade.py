import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.functions import addresses as ad
from mailsieve.functions import scoring as sc
from mailsieve.operators import cascade, lists, maintenance, stats, verdicts
from mailsieve.plans import jobs
from mailsieve.sources import mail, tables


def values(spark, expr, *inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_addresses(spark):
    assert values(spark, ad.extract_address, "A <a@b.c>", " a@b.c\t", "nobody", "<x> <y@z.w>", "", "<>@") == [
        "a@b.c", "a@b.c", "", "x", "", "<>@"]
    assert values(spark, ad.sender_domain, "a@B.c", "a@b@c.d", "x", "") == ["B.c", "c.d", "", ""]
    assert values(spark, ad.normalize_domain, "HTTP://A.b/c/d", " https://x.y ", "nodot", "", "a.b/") == ["a.b", "x.y", None, None, "a.b"]
    assert values(spark, ad.normalize_email, "A.b@C.de", "a@b", "a..b@c.de", "@c.de", "a b@c.de", " ok@x.org ") == [
        "a.b@c.de", None, None, None, None, "ok@x.org"]


def test_unknown_types_are_refused(spark):
    with pytest.raises(ValueError):
        lists.classify_items(spark.createDataFrame([("a",)], "raw_item string"), "phone")
    with pytest.raises(ValueError):
        lists.import_items(spark.createDataFrame([], lists.LIST_SCHEMA), spark.createDataFrame([], "raw_item string"), "greylist")
    with pytest.raises(ValueError):
        lists.clear_list(spark.createDataFrame([], lists.LIST_SCHEMA), "whitelist")


def test_list_files(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"emails": ["a@b.c", "a@b.c"], "domains": ["d.e"]}')
    (tmp_path / "broken.json").write_text('{"emails": ["a@b.c", ')
    (tmp_path / "l.txt").write_text("a@b.c\n\n  d.e \n")
    assert sorted(tables.read_list_json(spark, str(tmp_path / "w.json"), "whitelist").collect()) == [
        ("whitelist", "domain", "d.e"), ("whitelist", "email", "a@b.c")]
    assert tables.read_list_json(spark, str(tmp_path / "broken.json"), "whitelist").count() == 0
    assert sorted(tables.read_list_text(spark, str(tmp_path / "l.txt")).collect()) == [("a@b.c", "email"), ("d.e", "domain")]
    tables.export_list(tables.read_list_json(spark, str(tmp_path / "w.json"), "whitelist"), "whitelist", str(tmp_path / "out"))
    assert tables.read_list_json(spark, str(tmp_path / "out"), "whitelist").count() == 2


def test_exported_lists_read_back_in_both_forms(spark, tmp_path):
    rows = spark.createDataFrame(
        [("blacklist", "domain", f"{c}.de") for c in "cab"] + [("blacklist", "email", "x@y.z"), ("whitelist", "email", "o@y.z")], lists.LIST_SCHEMA)
    for one in (False, True):
        tables.export_list(rows, "blacklist", str(tmp_path / f"both-{one}"), one_document=one)
        back = tables.read_list_json(spark, str(tmp_path / f"both-{one}"), "blacklist")
        assert sorted(map(tuple, back.collect())) == sorted(tuple(r) for r in rows.where("list_type = 'blacklist'").collect())


def test_an_address_of_any_length_is_checked(spark):
    good, bad = "a@" + "b." * 100_000 + "com", "a@" + "b-" * 100_000 + ".com"
    dots, long = "x." * 100_000 + "x@y.de", "x" * 1_000_000 + "@y.de"
    assert [r is not None for r in values(spark, ad.normalize_email, good, bad, dots, long, "a..b@c.de", "a@b", "a@-b.de")] == [
        True, False, True, True, False, False, False]


def test_a_failing_prompt_fails_alone(spark):
    def scorer(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return ['{"is_spam":true}'] * len(prompts)
    pending = spark.createDataFrame([(str(i), "bad" if i == 7 else "good") for i in range(120)], "fingerprint string, prompt string")
    got = {r.fingerprint: r.decision for r in cascade.external_score(pending, scorer).collect()}
    assert [k for k, d in got.items() if d.method.endswith("_error")] == ["7"] and len(got) == 120
    rows = cascade.external_score(pending, scorer).select("fingerprint", "decision.*")
    assert cascade.scorer_cache_entries(rows, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).count() == 119


def test_export_keeps_its_order(spark, tmp_path):
    rows = spark.createDataFrame([("blacklist", "domain", f"{c}.de") for c in "cab"], lists.LIST_SCHEMA)
    tables.export_list(rows, "blacklist", str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == [
        f'{{"item_type":"domain","item":"{c}.de"}}' for c in "abc"]


@pytest.fixture
def frame(spark):
    def build(*rows):
        return spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)],
            "msg_id int, sender_email string, sender_domain string, fingerprint string, p_spam double, marketing_score double, prompt string")
    return build


CACHE = "fingerprint string, action string, reason string, confidence double, method string, override boolean"


def test_stage_order(spark, frame):
    people = spark.createDataFrame([
        ("whitelist", "email", "good@bad.tk"), ("blacklist", "domain", "bad.tk"), ("whitelist", "domain", "both.de"),
        ("blacklist", "domain", "both.de"), ("blacklist", "email", "x@sub.ok.de")], lists.LIST_SCHEMA)
    cache = spark.createDataFrame([
        ("f1", "KEEP", "r", 1.0, "user_feedback", False), ("f2", "SPAM", "r", 0.9, "llm_openai", False), ("f3", "SPAM", "r", 0.4, "x", True)], CACHE)
    rows = frame(
        ("Good@Bad.tk", "Bad.tk", "f2", 0.99, 0.0, "p"), ("other@bad.tk", "", "f1", 0.1, 0.0, "p"), ("a@both.de", "both.de", "f9", 0.99, 0.0, "p"),
        ("a@x.de", "x.de", "f1", 0.99, 0.0, "p"), ("a@x.de", "x.de", "f3", 0.99, 0.0, "p"), ("a@x.de", "x.de", "f2", 0.81, 0.0, "p"),
        ("a@x.de", "x.de", "f2", 0.8, 0.0, "p"), ("a@x.de", "x.de", "f8", 0.3, 0.85, "p"), ("a@x.de", "x.de", "f7", 0.3, 0.7, "prize"),
        ("a@x.de", "x.de", "f7", 0.3, 0.0, "prize"), ("a@x.de", "x.de", "f6", None, 0.9, "p"), ("y@deep.sub.ok.de", "deep.sub.ok.de", "f5", 0.01, 0.0, "p"))
    calls = []

    def scorer(prompts):
        return ['{"is_spam":true,"confidence":0.9,"reason":"bait"}' if p == "prize" else "no idea" for p in prompts]

    got = {r.msg_id: (r.action, r.method, r.reason) for r in cascade.classify(rows, people, cache, scorer=scorer).collect()}
    assert got[0] == ("KEEP", "whitelist", "WHITELIST: Email 'good@bad.tk' is whitelisted")
    assert got[1] == ("SPAM", "blacklist", "BLACKLIST: Domain 'bad.tk' is blacklisted")
    assert got[2][1] == "whitelist"
    assert got[3] == ("KEEP", "user_feedback", "r (user feedback)") and got[4] == ("SPAM", "x", "r (user feedback)")
    assert got[5] == ("SPAM", "ml_random_forest", "ML: Spam (conf: 0.81)")
    assert got[6] == ("SPAM", "llm_openai", "r (cached)")
    assert got[7] == ("SPAM", "ml_marketing", "ML: Marketing content detected (score: 0.85)")
    assert got[8] == got[9] == ("SPAM", "llm_openai", "OpenAI: bait")
    assert got[10] == ("KEEP", "llm_openai", "OpenAI: no idea")
    assert got[11] == ("KEEP", "ml_random_forest", "ML: Ham (conf: 0.99)")
    assert len(got) == 12 and calls == []


def test_rows_of_one_fingerprint_are_judged_by_their_own_prompts(spark, frame):
    rows = frame(*[("a@x.de", "x.de", "same", 0.3, 0.0, p) for p in ("a plain one", "prize", "prize", "z plain one", None)])
    log = spark.sparkContext.accumulator(0)

    def scorer(prompts):
        log.add(len(prompts))
        return ['{"is_spam":true}' if p == "prize" else '{"is_spam":false}' for p in prompts]

    out = cascade.classify(rows, spark.createDataFrame([], lists.LIST_SCHEMA), None, scorer=scorer)
    assert {r.msg_id: r.action for r in out.collect()} == {0: "KEEP", 1: "SPAM", 2: "SPAM", 3: "KEEP", 4: "KEEP"}
    assert log.value == 4  # each prompt once


def test_scorer_failures(spark):
    prompts = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "fingerprint string, prompt string")

    def broken(batch):
        raise RuntimeError("down")

    rows = cascade.external_score(prompts, broken, "mistralai").select("fingerprint", "decision.*").orderBy("fingerprint").collect()
    assert [tuple(r) for r in rows] == [(f, "KEEP", "MistralAI error: down", 0.5, "llm_mistralai_error") for f in "ab"]
    none = cascade.external_score(prompts, None).select("decision.*").distinct().collect()
    assert [r.method for r in none] == ["llm_unavailable"]
    short = cascade.external_score(prompts, lambda p: [], "openai").select("decision.method").distinct().collect()
    assert [r.method for r in short] == ["llm_openai_error"]


def test_parse_verdict(spark):
    replies = ['{"is_spam": "false"}', '{"is_spam": 0, "confidence": 2}', "42", '{"confidence": "high"}', '{"is_spam":true,"confidence":null}', " YES ", '"spam"']
    got = values(spark, lambda c: sc.parse_verdict(c, "OpenAI"), *replies)
    assert [(v.action, v.confidence, v.method) for v in got] == [
        ("SPAM", 0.5, "llm_openai"), ("KEEP", 1.0, "llm_openai"), ("KEEP", 0.5, "llm_openai_error"), ("KEEP", 0.5, "llm_openai_error"),
        ("KEEP", 0.5, "llm_openai_error"), ("SPAM", 0.7, "llm_openai"), ("KEEP", 0.5, "llm_openai_error")]


def test_provider_choice():
    assert sc.choose_provider("MistralAI", ["openai", "mistralai"]) == "mistralai"
    assert sc.choose_provider("anthropic", ["MistralAI", "OpenAI"]) == "openai"
    assert sc.choose_provider("openai", []) is None


def test_prompt(spark, messages):
    m = messages(
        {"sender_email": "ca@creditagrlcole.fr", "subject": "CreditAgricole: compte", "body": "b" * 2001,
         "raw_headers": {"Reply-To": ["x@y.z"], "Return-Path": ["ca@creditagrlcole.fr"]}}, {"body": "only"})
    rows = m.select(sc.scorer_prompt(F.col("sender_email"), F.col("subject"), F.col("body")).alias("p")).collect()
    assert rows[0].p.split("\n") == [
        "From: ca@creditagrlcole.fr", "Sender Domain: creditagrlcole.fr", "Subject: CreditAgricole: compte",
        "⚠️ BRAND MISMATCH: Subject mentions 'credit agricole' but sender is ca@creditagrlcole.fr",
        "Content: " + "b" * 2000 + "... [truncated]",
        "Headers: Auth= | List-Unsubscribe=absent | ReplyToMismatch=yes | ReturnPathMismatch=no"]
    assert rows[1].p == "Content: only"


def test_ml_fallbacks(spark):
    row = spark.createDataFrame([(None, 0.9, False), (0.4, 0.9, True), (0.5, 0.6, False)], "p double, m double, bad boolean")
    out = row.select(sc.ml_verdict(F.col("p"), F.col("m"), EngineConfig(), F.col("bad")).alias("v")).select("v.*").collect()
    assert [(r.action, r.confidence, r.method) for r in out] == [("KEEP", 0.5, "ml_unavailable"), ("KEEP", 0.5, "ml_error"), ("SPAM", 0.6, "ml_marketing")]
    plain = row.select(sc.ml_verdict(F.col("p"), F.col("m"), EngineConfig(classify_marketing_as_spam=False)).alias("v")).select("v.method").collect()
    assert [r.method for r in plain] == ["ml_unavailable", "ml_random_forest", "ml_random_forest"]


def test_cache_expiry(spark):
    rows = [("old", dt.datetime(2024, 1, 30, 23, 59)), ("edge", dt.datetime(2024, 1, 31)), ("none", None)]
    cache = spark.createDataFrame(rows, "fingerprint string, cached_at timestamp_ntz")
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert {r[0] for r in verdicts.live_cache(cache, 30, as_of).collect()} == {"edge", "none"}
    assert verdicts.live_cache(cache, 0, as_of).count() == 3


def test_cache_versions(spark, tmp_path):
    schema = tables.CACHE_SCHEMA
    root, as_of = str(tmp_path), F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert tables.read_verdict_cache(spark, root, 30, as_of).count() == 0
    row = ("f", "SPAM", "r", 0.9, "llm_openai", False, dt.datetime(2024, 2, 29))
    tables.write_verdict_cache(spark, root, spark.createDataFrame([row], schema), 1)
    tables.write_verdict_cache(spark, root, spark.createDataFrame([("f", "KEEP", *row[2:]), ("g", *row[1:])], schema), 2)
    assert {(r.fingerprint, r.action) for r in tables.read_verdict_cache(spark, root, 30, as_of).collect()} == {("f", "KEEP"), ("g", "SPAM")}


MAILBOX = "msg_id int, account string, folder string, received_at timestamp_ntz"


def test_purge(spark):
    rows = spark.createDataFrame([
        (1, "p", "SPAM_AUTO", dt.datetime(2024, 2, 19, 23, 59)), (2, "p", "SPAM_AUTO", dt.datetime(2024, 2, 20)), (3, "p", "INBOX", dt.datetime(2020, 1, 1)),
        (4, "w", "junk", dt.datetime(2020, 1, 1)), (5, "w", "SPAM_AUTO", dt.datetime(2020, 1, 1))], MAILBOX)
    accounts = spark.createDataFrame([("p", None), ("w", "junk")], "name string, spam_folder string")
    as_of = F.lit("2024-03-01 15:00:00").cast("timestamp")
    left, gone = maintenance.purge_old_spam(rows, 10, as_of, accounts)
    assert {r.msg_id for r in gone.collect()} == {1, 4} and {r.msg_id for r in left.collect()} == {2, 3, 5}
    assert maintenance.old_spam(rows, 0, as_of, accounts).count() == 0
    assert maintenance.kept_mail(rows, 0, as_of, accounts).count() == 5
    undated = rows.withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    assert maintenance.kept_mail(undated, 10, as_of, accounts).count() == 5


EML = {
    "plain.eml": b"From: Ann <ann@x.org>\nTo: me\nSubject: Hi\nDate: Tue, 5 Mar 2024 09:08:07 +0100\n\nhello\nthere",
    "multi.eml": b'From: b@y.org\nSubject: =?utf-8?b?w6k=?=\nReceived: one; x\nReceived: two\nContent-Type: multipart/mixed; boundary=q\n\n--q\n'
                 b"Content-Type: text/plain\n\nfirst\n--q\nContent-Type: text/html\n\n<b>no</b>\n--q\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\nc2Vjb25k\n--q--\n",
    "html.eml": b"From: nobody\nContent-Type: multipart/alternative; boundary=q\n\n--q\nContent-Type: text/html\n\n<b>x</b>\n--q--\n",
    "latin.eml": "From: c@z.org\nDate: 2024-03-05T10:11:12Z\nContent-Type: text/plain; charset=latin-1\n\ncafé!".encode("latin-1"),
    "nested.eml": b"From: d@z.org\nDate: never\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain; boundary=r\n\nok\n--q--\n",
}


def test_ingest(spark, tmp_path):
    for name, content in EML.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.id.split("/")[-1]: r for r in mail.ingest_mail(spark, str(tmp_path)).collect()}
    p, m, h, l = (rows[f"{n}.eml"] for n in ("plain", "multi", "html", "latin"))
    assert (p.sender_email, p.sender_domain, p.subject, p.body, p.error) == ("ann@x.org", "x.org", "Hi", "hello\nthere", None)
    assert p.received_at == dt.datetime(2024, 3, 5, 9, 8, 7)
    assert (m.body, m.raw_headers["Received"], m.subject) == ("firstsecond", ["one; x", "two"], "=?utf-8?b?w6k=?=")
    assert (h.sender_email, h.sender_domain, h.body, h.received_at) == ("", "", "", None)
    assert l.body == "caf!" and l.received_at == dt.datetime(2024, 3, 5, 10, 11, 12)
    assert rows["nested.eml"].received_at is None


def test_corrupt_mail_gives_an_error_row(spark):
    raw = spark.createDataFrame([("1", bytearray(b"From: a@b.c\n\nok")), ("2", None), (
        "3", bytearray(b"Content-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: message/rfc822\n\nSubject: x\n\n--q--"))], "id string, content binary")
    out = mail.parse_mail(raw)
    assert {r.id for r in mail.failed_mail(out).collect()} == {"2"}
    assert {r.id for r in mail.good_mail(out).collect()} == {"1", "3"}


def test_dates(spark):
    got = values(spark, mail.received_at, "1 Jan 2024 00:00 GMT", "Sun, 31 Feb 2024 10:00:00 +0000", "2024-02-30", "2024-02-03", "3 Foo 2024 10:00:00", "", None,
                 "2024-05-06 07:08:09.5+02:00")
    assert got == [dt.datetime(2024, 1, 1), None, None, dt.datetime(2024, 2, 3), None, None, None, dt.datetime(2024, 5, 6, 7, 8, 9, 500000)]


def test_whole_run(spark, messages):
    rows = messages(
        {"sender_email": "a@bad.tk", "sender_domain": "bad.tk", "subject": "s", "body": "text"}, {"sender_email": "b@ok.de", "sender_domain": "ok.de", "subject": "t", "body": "more"})
    listed = spark.createDataFrame([("blacklist", "domain", "bad.tk")], lists.LIST_SCHEMA)
    box = rows.withColumns({"account": F.lit("p"), "folder": F.lit("INBOX"), "was_unread": F.lit(True)})
    accounts = spark.createDataFrame([("p", None)], "name string, spam_folder string")
    run = jobs.run_detection(
        box, listed, None, None, None, accounts, as_of=F.lit("2024-03-01 00:00:00").cast("timestamp"), scorer=lambda p: ["fine"] * len(p))
    got = {r.sender_email: (r.action, r.method, r.target_folder, r.marked_read) for r in run.decisions.collect()}
    assert got == {"a@bad.tk": ("SPAM", "blacklist", "SPAM_AUTO", True), "b@ok.de": ("KEEP", "llm_openai", "INBOX", False)}
    assert run.summary.first().asDict() == {"account": "p", "processed": 2, "spam_detected": 1, "spam_moved": 1, "errors": 0, "cleanup_deleted": 0}
    assert run.new_cache_entries.count() == 1
    assert run.decisions.where("marketing_score IS NULL").count() == 0  # also for listed mail, whatever the list
    assert cascade.decision_log(run.decisions).count() == 2
    other = jobs.run_detection(box.withColumn("folder", F.lit("SPAM_AUTO")), listed, None, None, None, accounts, as_of=F.lit("2024-03-01 00:00:00").cast("timestamp"))
    assert other.decisions.count() == 0
    facts = jobs.decision_facts(run.decisions, F.lit("2024-03-01 00:00:00"), 0.25)
    assert stats.detection_totals(verdicts.dedup_decisions(facts)).first().asDict() == {"total": 2, "spam": 1, "ham": 1, "spam_rate": 50.0}
    assert stats.avg_processing_time(facts).first()[0] == 0.25


def test_whole_run_is_a_query_over_all_messages(spark, sf):
    import __spark_entry__
    from catalog.fixtures import view

    got = __spark_entry__.queries()["detection_run"](spark, sf).collect()
    box = jobs.with_fingerprint(view(spark, sf, "messages"))
    assert {r.processed for r in got} == {box.count()} and sum(r.decisions for r in got) == box.select("fingerprint").distinct().count()
    by_forest = {r.action: r.decisions for r in got if r.method == "ml_random_forest"}
    assert by_forest["SPAM"] > 0 and by_forest["KEEP"] > 0 and {"whitelist", "blacklist"} <= {r.method for r in got}
