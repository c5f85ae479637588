"""Features on hand-made rows, compared with plain Python."""

import datetime as dt
import math
import re
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailsieve.functions import features as ft
from mailsieve.functions import fixed_values as fv
from mailsieve.functions import text as tx



def as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


TEXTS = [
    "", "x", "Hello World", "a\x1cb　c d e\x85f", "ÄÖÜ ß É Ⓐ İstanbul ΣΑΣ", "www.promo.tk http://a.b/?u=http://c.ml www. http://",
    "call +1 (555) 123-4567 or 555.123.4567 or 5551234567 or 123456", "a@b.cc.d@e.ff .x@y.zz é@b.cc éa.b@c.dd a@b@c.dd a@b.c1 %%a@b.cc|x@y.zz", "write a.b@c.org, x@y.z, ü@a.de é1@b.com <m@n.io>", "12 a12 12a ½ ２２ 3,4 5_6",
    "limited time limited subscribe unsubscribe registeregister exclusivexclusive share thishare this", "<a><b\n>x</b> <IMG SRC='q' alt=\"z\"> < > <form>",
    "20% off 5 % off 30%\toff $5 €6 £7 save $ % discount price", "free free FREE free lottery", "line\n\nline\n", "naïve café 数字 ١٢٣ 😀😀 a😀b",
    "http://safe.com/a.clickable https://x.y/z.download, www.topic.org www.a.top", "a b a b a b a c", "it costs\r\n\r\n$12",
]


@pytest.fixture(scope="module")
def computed(spark):
    rows = spark.createDataFrame(
        [(i, "U.s-er1@Mail.Example.TK", "Mail.Example.TK", t, t) for i, t in enumerate(TEXTS)],
        "msg_id bigint, sender_email string, sender_domain string, subject string, body string").withColumns({
            "raw_headers": F.lit(None).cast("map<string,array<string>>"), "received_at": F.lit(None).cast("timestamp_ntz")})
    return {r["msg_id"]: r.asDict() for r in ft.extract_features(rows, as_of=as_of()).collect()}


def expect(name, fn):
    return pytest.param(name, fn, id=name)


LINK = r'[^\s<>"{}|\\^`\[\]]+'
URL = rf"https?://{LINK}|www\.{LINK}"


def links(t):
    return re.findall(URL, t.lower())


def entropy(t):
    c = Counter(f"{t} {t}".lower().split())
    n = sum(c.values())
    return -sum(v / n * math.log2(v / n) for v in c.values()) if n else 0.0


def found(pattern, t):
    return len(list(re.finditer(pattern, t)))


@pytest.mark.parametrize("name, fn", [
    expect("subject_length", len), expect("content_word_count", lambda t: len(t.split())),
    expect("content_caps_ratio", lambda t: sum(c.isupper() for c in t) / len(t) if t else 0),
    expect("subject_special_chars", lambda t: sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in t)),
    expect("content_url_count", lambda t: len(links(t))),
    expect("content_suspicious_tld_count", lambda t: sum(any(x in u for x in fv.FEATURE_TLDS) for u in links(t))),
    expect("content_email_count", lambda t: found(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", t)),
    expect("content_phone_count", lambda t: found(r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", t)),
    expect("content_number_count", lambda t: found(r"\b\d+\b", t)),
    expect("content_line_count", lambda t: t.count("\n") + 1 if t else 0),
    expect("content_avg_line_length", lambda t: sum(map(len, t.split("\n"))) / len(t.split("\n")) if t else 0),
    expect("content_marketing_keywords", lambda t: sum(t.lower().count(k) for k in fv.LEXICONS["marketing"])),
    expect("content_money_keywords", lambda t: sum(t.lower().count(k) for k in fv.LEXICONS["money"])),
    expect("subject_marketing_keywords", lambda t: sum(k in t.lower() for k in fv.LEXICONS["marketing"])),
    expect("content_newsletter_phrases", lambda t: sum(t.lower().count(k) for k in fv.NEWSLETTER_PHRASES)),
    expect("content_cta_count", lambda t: sum(t.lower().count(k) for k in fv.CTA_PHRASES)),
    expect("content_html_tag_count", lambda t: found("<[^>]+>", t)),
    expect("content_image_count", lambda t: sum(found(p, t.lower()) for p in (
        "<img[^>]*>", "src=['\"][^>]*['\"]", "alt=['\"][^>]*['\"]", r"\[image\]", r"\[logo\]", r"\[banner\]"))),
    expect("content_price_indicators", lambda t: sum(found(p, t.lower()) for p in (
        r"\d+%\s*off", r"\$\d+", r"€\d+", r"£\d+", "price", "cost", r"save \$", "discount", "% discount"))),
    expect("text_entropy", entropy),
    expect("text_unique_word_ratio", lambda t: len(set(t.lower().split())) / (2 * len(t.split())) if t.split() else 0),
    expect("text_avg_word_length", lambda t: sum(map(len, t.lower().split())) / len(t.split()) if t.split() else 0),
    expect("text_repeated_words", lambda t: sum(v > 3 for v in Counter(f"{t} {t}".lower().split()).values())),
    expect("rich_html_to_text_ratio", lambda t: sum(map(len, re.findall("<[^>]+>", t))) / len(t) if t else 0),
    expect("rich_has_forms", lambda t: float(bool(re.search("<form[^>]*>", t, re.I)))),
    expect("rich_link_density", lambda t: found(rf"https?://{LINK}", t) * 100 / len(t) if t else 0),
])
def test_equals_python(computed, name, fn):
    for i, text in enumerate(TEXTS):
        assert computed[i][name] == pytest.approx(fn(text), abs=1e-9), text


def test_79_names():
    assert len(fv.FEATURE_NAMES) == 79 and list(fv.FEATURE_NAMES) == sorted(fv.FEATURE_NAMES)


def test_sender_features(computed):
    row = computed[0]
    assert (row["sender_suspicious_tld"], row["sender_local_length"], row["sender_has_numbers"], row["sender_has_special_chars"]) == (1, 7, 1, 1)


def test_missing_fields(spark, messages):
    row = ft.extract_features(messages({}), as_of=as_of()).first().asDict()
    nonzero = {k for k, v in row.items() if v}
    assert nonzero <= {"temporal_hour_of_day", "temporal_day_of_week", "temporal_is_night_time"}  # a Friday, midnight


def test_text_content_replaces_missing_body(spark):
    rows = spark.createDataFrame([(1, "s", None, "old text"), (2, "s", "", "old text")], "msg_id long, subject string, body string, text_content string")
    rows = rows.withColumns({n: F.lit("") for n in ("sender_email", "sender_domain")}).withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    got = {r[0]: r[1] for r in ft.extract_features(rows, groups=("metadata",)).select("msg_id", "content_length").collect()}
    assert got == {1: 8, 2: 0}


def test_headers(messages):
    head = {
        "Authentication-Results": ["mx; SPF=pass", "dkim=pass header.d=mail.shop.com; dmarc=fail"], "Reply-To": ["Other@x.com"],
        "List-Unsubscribe": ["<mailto:a>"], "Message-ID": ["<1@eu.shop.com>"], "Received": ["a; b; c"]}
    many = {"Received": ["a; b", "c"], "Authentication-Results": [], "Reply-To": ["b@shop.com"]}
    rows = ft.extract_features(
        messages({"sender_email": "b@shop.com", "sender_domain": "Shop.com", "raw_headers": head},
                 {"sender_email": "b@shop.com", "sender_domain": "shop.com", "raw_headers": many},
                 {"raw_headers": {"Received": [""]}}), groups=("headers",)).orderBy("msg_id").collect()
    names = fv.FEATURE_GROUPS["headers"]
    assert [rows[0][n] for n in names] == [1, 1, 0, 1, 1, 1, 1, 2]
    assert [rows[1][n] for n in names] == [0, 0, 0, 0, 0, 0, 0, 2]
    assert rows[2]["received_hops"] == 1


def test_history_is_matched_in_any_case(spark, messages):
    past = spark.createDataFrame(
        [("bob@x.org", "x.org", 3, 1, 9, 9, dt.datetime(2024, 2, 1, 12), dt.datetime(2024, 2, 2))],
        "sender_email string, sender_domain string, spam_count bigint, ham_count bigint, whitelist_count bigint, blacklist_count bigint, "
        "first_seen timestamp_ntz, last_seen timestamp_ntz")
    mail = messages({"sender_email": "Bob@X.org"}, {"sender_email": "new@x.org"})
    rows = ft.extract_features(mail, past, as_of=as_of(), groups=("history",)).orderBy("msg_id").collect()
    assert list(rows[0])[1:] == [0.75, 4, 28, 1, 0] and list(rows[1])[1:] == [0, 0, 0, 0, 0]
    flat = ft.extract_features(mail, past, as_of=as_of(), groups=("history",), compat_zero_days=True).orderBy("msg_id").first()
    assert flat["sender_days_since_first"] == 0


def test_vector_follows_sorted_names(messages):
    feats = ft.extract_features(messages({"subject": "abc", "body": "defg"}), as_of=as_of())
    vector = ft.to_vector(feats.drop("text_entropy")).first()["features"]
    assert vector[fv.FEATURE_NAMES.index("subject_length")] == 3 and vector[fv.FEATURE_NAMES.index("text_entropy")] == 0
    assert len(vector) == 79


def test_custom_lexicon(messages):
    own = {**fv.LEXICONS, "scam": ("gold.bar", "aa")}
    row = ft.extract_features(messages({"subject": "goldxbar", "body": "Gold.Bar aaaaa"}), groups=("content",), lexicons=own).first()
    assert row["content_scam_keywords"] == 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([
    *"abdelsuicrptonf \t\n<>@.1$%Ä", "\u3000", "!", "limited time", "unsubscribe", "http://x", "www.", ".tk", "deal", "sale", "exclusiv", "e"]),
    max_size=60).map("".join), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").withColumn("l", F.lower("t"))
    out = rows.select("i", tx.total_occurrences(F.col("l"), fv.LEXICONS["marketing"]).alias("m"), F.size(tx.words(F.col("t"))).alias("w"),
                      ft._suspicious_links(F.col("l")).alias("u")).collect()
    for r in out:
        low = texts[r.i].lower()
        assert r.m == sum(low.count(k) for k in fv.LEXICONS["marketing"])
        assert r.w == len(texts[r.i].split())
        assert r.u == sum(any(x in u for x in fv.FEATURE_TLDS) for u in links(low))


def test_phrases_are_counted_where_one_scan_finds_them(spark):
    """Counts by way of the pieces around phrases equal plain counts: overlaps, wide characters, quoting, long texts."""
    phrases = ("limited", "limited time", "time limit", "ee", "free", "a.b", "$5", "[x]", "\U0001f600go", "é", "go \U0001f600", "z", "e t")
    texts = ["", "limited time limit", "\U0001f600" * 40 + "free" + "\U0001f600go \U0001f600" * 30, "freeee a.b axb [x] $5\n$5", "étéz" * 50,
             "free the time", "\U0001f600" * 9 + "limited time", "x" * 1_000_001 + "free"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").withColumn("near", tx.around_phrases(F.col("t"), phrases))
    out = rows.select("i", tx.total_occurrences(F.col("t"), phrases, F.col("near")).alias("n"), F.length("near").alias("size"),
                      *[F.contains("near", F.lit(p)).alias(f"p{k}") for k, p in enumerate(phrases)]).collect()
    for r in out:
        assert r.n == sum(texts[r.i].count(p) for p in phrases)
        assert [r[f"p{k}"] for k in range(len(phrases))] == [p in texts[r.i] for p in phrases]
    assert rows.filter("t = ''").first()["near"] == ""


def test_word_statistics_from_runs(spark):
    row = spark.range(1).select(F.sort_array(F.split(F.lit("a a a a b b c"), " ")).alias("w")).select(
        tx.word_statistics(F.col("w")).alias("s")).first()["s"]
    assert (row["distinct"], row["repeated"]) == (3, 1) and row["clogc"] == pytest.approx(4 * 2 + 2 * 1)


def test_word_statistics_of_any_run(spark):
    texts = ["", "a", "a a", "a b c", "b a b a b", "x " * 2000 + "y", "a aa aaa aa a a a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    out = rows.select("i", tx.word_statistics(F.sort_array(tx.words(F.col("t")))).alias("s")).collect()
    for r in out:
        runs = Counter(texts[r.i].split()).values()
        assert (r.s["distinct"], r.s["repeated"]) == (len(runs), sum(c > 3 for c in runs))
        assert r.s["clogc"] == pytest.approx(sum(c * math.log2(c) for c in runs))


def test_links_are_looked_for_once(spark, messages):
    """Their number and their endings come from one scan of the text."""
    jvm, name = spark._jvm, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        frame = ft.extract_features(messages({}), groups=("content",))
        mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        text = frame._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set(name, before)
    assert text.count("https?://") == 1


def test_addresses_are_counted_between_blanks(spark):
    texts = ["a@b.cc", " a@b.cc  c@d.ee ", "x a@b.cc,c@d.ee\nf@g.hh y", "@ a @b.cc a@ b.cc", "a@b.cc.d@e.ff g@h.ii", "é@b.cc a.é@c.dd", "no", "",
             "\u212a@b.cc \u0130i@c.dd", "a@b.cc\u00a0c@d.ee", "-a@b.cc a-@b.cc %@b.cc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    out = rows.select("i", ft._email_addresses(F.col("t")).alias("n"), tx.matches(F.col("t"), ft.EMAIL).alias("plain")).collect()
    for r in out:
        assert r.n == r.plain == found(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", texts[r.i]), texts[r.i]


def test_words_are_cut_at_every_kind_of_whitespace(spark):
    texts = [f"\u00e9{blank}b{blank}{blank}c d\ne" for blank in fv.WHITESPACE_CHARS] + ["\u00e9 b\nc", "\u2010a\u20ac \u3001b", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    for r in rows.select("i", tx.words(F.col("t")).alias("w")).collect():
        assert r.w == texts[r.i].split(), repr(texts[r.i])


def test_phrases_of_common_letters_are_counted(spark):
    phrases = ("share this", "noon", "free", "refer a friend to this")
    texts = ["share this share this", "no on noon", "afternoon freedom", "refer a friend to this share thi", "", "share\nthis"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").withColumn("near", tx.around_phrases(F.col("t"), phrases))
    for r in rows.select("i", tx.total_occurrences(F.col("t"), phrases, F.col("near")).alias("n")).collect():
        assert r.n == sum(texts[r.i].count(p) for p in phrases), texts[r.i]


def test_long_text_is_read_whole(messages):
    body = "plain words here " * 200_000 + "unsubscribe"
    row = ft.extract_features(messages({"body": body, "subject": ""}), as_of=as_of(), groups=("metadata", "newsletter", "text")).first()
    assert (row["content_length"], row["content_newsletter_phrases"]) == (len(body), 1)
    assert row["content_word_count"] == 600_001


@pytest.mark.parametrize("body", ["<" * 300_000, "<img " * 60_000, "http://" * 40_000, "1" * 300_000 + "%", "www." * 60_000 + " x.tk", "a." * 100_000 + "@"],
                         ids=["open tags", "open images", "link starts", "digits", "www", "dots"])
def test_hostile_texts_take_no_longer(messages, body):
    started = time.monotonic()
    ft.extract_features(messages({"body": body, "subject": ""}), as_of=as_of()).collect()
    assert time.monotonic() - started < 20
