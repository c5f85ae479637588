"""Mail-shaped views over the given tables.

The same SQL text runs in Spark and in DuckDB, so that queries and oracles start from equal rows. Every
view reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the address syntax for the SQL engine, whose patterns are always linear
SQL_ADDRESS = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

_DOMAIN = """CASE ({n}) % 8 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'example.com' WHEN 2 THEN 'news.example.org'
    WHEN 3 THEN 'lottery.tk' WHEN 4 THEN 'cheap.ml' WHEN 5 THEN 'company.com' WHEN 6 THEN 'free.fr' ELSE 'promo.click' END"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view("messages", (), f"""
SELECT d.doc_id AS msg_id,
  CASE WHEN d.doc_id % 3 = 0 THEN 'work' ELSE 'personal' END AS account,
  'user' || CAST(d.doc_id % 97 AS STRING) || '@' || {_DOMAIN.format(n='d.doc_id % 97')} AS sender_email,
  {_DOMAIN.format(n='d.doc_id % 97')} AS sender_domain,
  CASE d.doc_id % 7 WHEN 0 THEN 'RE: ' WHEN 1 THEN '[news] ' WHEN 2 THEN 'FREE PRIZE WINNER!!! ' WHEN 3 THEN 'PayPal alert? '
    ELSE '' END || substring(split_part(d.text, chr(10), 1), 1, 60) AS subject,
  d.text || CASE d.doc_id % 10
    WHEN 0 THEN ''
    WHEN 1 THEN chr(10) || 'URGENT! Act now, limited time. Claim your FREE cash prize: http://win.lottery.tk/go?id=7 !!!'
    WHEN 2 THEN chr(10) || 'Please verify your account password, login suspended. https://secure.example.com/login'
    WHEN 3 THEN chr(10) || 'Newsletter: 20% off, save $5, discount price. Unsubscribe or manage preferences http://n.example.org/u?utm_source=a&utm_campaign=b'
    WHEN 4 THEN chr(10) || 'Meeting at 10, call (555) 123-4567 or write to team@example.com'
    WHEN 5 THEN chr(10) || 'inheritance transfer of funds to the beneficiary, 1000000 in cash'
    WHEN 6 THEN chr(10) || 'Follow us on facebook.com and twitter.com. Shop now, sign up, learn more. www.promo.click/x'
    WHEN 7 THEN chr(10) || '<html><img src="a.png" alt="logo"><form action="/f"><input></form><script>t()</script><p>Buy now</p><a href="http://shop.example.net/d">deal</a></html>'
    WHEN 8 THEN chr(10) || 'buy buy buy buy buy buy now now now now'
    ELSE chr(10) || 'Order 123456789 has shipped. View in browser.' END AS body,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '37' MINUTE AS received_at,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL
       WHEN d.doc_id % 5 = 1 THEN 'mx; spf=pass; dkim=pass header.d=example.com; dmarc=pass'
       WHEN d.doc_id % 5 = 2 THEN 'mx; spf=pass; dkim=fail header.d=lottery.tk; dmarc=fail'
       ELSE 'mx; spf=fail; dkim=none; dmarc=fail' END AS hdr_auth_results,
  CASE WHEN d.doc_id % 10 = 3 THEN '<mailto:u@news.example.org>' END AS hdr_list_unsubscribe,
  CASE WHEN d.doc_id % 6 = 0 THEN 'other@reply.example.net' END AS hdr_reply_to,
  CASE WHEN d.doc_id % 6 = 1 THEN 'bounce@reply.example.net' END AS hdr_return_path,
  CASE WHEN d.doc_id % 4 = 0 THEN '<m' || CAST(d.doc_id AS STRING) || '@example.com>'
       WHEN d.doc_id % 4 = 1 THEN 'no-at-sign' END AS hdr_message_id,
  CAST(d.doc_id % 4 AS INT) AS hdr_received_hops,
  d.doc_id % 2 = 0 AS was_unread
FROM documents d""")

# heavy senders (the 97 of the messages) and many light ones; some mixed-case or broken addresses
_view("feedback_base", (), """
SELECT event_id, ts, user_id,
  CASE WHEN user_id % 2 = 0 THEN user_id % 97 ELSE 97 + user_id * 13 + event_id % 13 END AS n,
  CASE event_type WHEN 'purchase' THEN 'whitelist' WHEN 'signup' THEN 'blacklist'
    WHEN 'view' THEN 'not_spam' ELSE 'is_spam' END AS feedback_type
FROM events WHERE event_type <> 'click'""")
_view("feedback", ("feedback_base",), f"""
SELECT event_id AS seq, ts AS at, CASE WHEN user_id % 3 = 0 THEN 'work' ELSE 'personal' END AS account,
  CASE WHEN event_id % 50 = 7 THEN 'broken' || CAST(n AS STRING)
       ELSE CASE WHEN event_id % 11 = 0 THEN 'User' ELSE 'user' END || CAST(n AS STRING) || '@' || {_DOMAIN.format(n='n')} END AS sender_email,
  CASE WHEN event_id % 50 = 7 THEN '' WHEN event_id % 13 = 0 THEN upper({_DOMAIN.format(n='n')}) ELSE {_DOMAIN.format(n='n')} END AS sender_domain,
  feedback_type, md5(CAST(event_id % 3001 AS STRING)) AS fingerprint
FROM feedback_base""")
_view("sender_list", (), """
SELECT * FROM (VALUES
  ('whitelist', 'domain', 'company.com'), ('whitelist', 'email', 'user8@gmail.com'),
  ('whitelist', 'email', 'user3@lottery.tk'),
  ('blacklist', 'domain', 'lottery.tk'), ('blacklist', 'email', 'user7@promo.click'),
  ('blacklist', 'domain', 'company.com')) AS t(list_type, item_type, item)""")
_view("decisions", (), """
SELECT md5(CAST(event_id % 9000 AS STRING)) AS fingerprint, event_id AS seq, ts AS decided_at,
  CASE WHEN event_id % 3 = 0 THEN 'SPAM' ELSE 'KEEP' END AS action,
  CASE event_id % 9 WHEN 0 THEN 'whitelist' WHEN 1 THEN 'blacklist' WHEN 2 THEN 'ml_random_forest'
    WHEN 3 THEN 'llm_openai' WHEN 4 THEN 'llm_anthropic' WHEN 5 THEN 'default' WHEN 6 THEN 'ml_marketing'
    WHEN 7 THEN 'user_feedback' ELSE 'llm_mistralai' END AS method,
  CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS confidence,
  value / 1000 AS processing_time
FROM events""")
_view("model_scores", (), "SELECT doc_id AS msg_id, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS p_spam FROM documents")
_view("verdict_text", (), """
SELECT doc_id AS msg_id, CASE doc_id % 9
  WHEN 0 THEN '{"is_spam":true,"confidence":0.95,"reason":"phishing"}'
  WHEN 1 THEN '{"is_spam":false,"confidence":1.7,"reason":"ok"}'
  WHEN 2 THEN '{"is_spam":true}'
  WHEN 3 THEN 'This is not spam'
  WHEN 4 THEN 'yes'
  WHEN 5 THEN 'That is TRUE'
  WHEN 6 THEN '  {"is_spam": false, "confidence": -3}  '
  WHEN 7 THEN '```json {"is_spam": false} ```'
  ELSE 'legitimate mail' END AS reply
FROM documents""")
_view("accounts", (), "SELECT * FROM (VALUES ('personal', CAST(NULL AS STRING)), ('work', 'spam')) AS t(name, spam_folder)")
_view("mailbox", ("messages", "model_scores"), """
SELECT m.msg_id, m.account, m.received_at,
  CASE WHEN s.p_spam > 0.5 THEN CASE WHEN m.account = 'work' THEN 'spam' ELSE 'SPAM_AUTO' END ELSE 'INBOX' END AS folder
FROM messages m JOIN model_scores s ON s.msg_id = m.msg_id""")
# verdicts are on file for the labelled messages
_view("verdict_cache", ("messages",), """
SELECT md5(m.sender_email || m.subject || substring(m.body, 1, 200)) AS fingerprint,
  min(CASE WHEN l.toxic = 1 THEN 'SPAM' ELSE 'KEEP' END) AS action,
  'stored' AS reason,
  min(CASE WHEN l.quality = 0 THEN 'user_feedback' ELSE 'llm_openai' END) AS method,
  min(CAST(m.msg_id % 11 AS DOUBLE) / 10) AS confidence,
  min(CASE WHEN m.msg_id % 5 <> 0 THEN TIMESTAMP '2024-03-01 00:00:00' - (m.msg_id % 60) * INTERVAL '1' DAY END) AS cached_at
FROM messages m JOIN labels l ON l.doc_id = m.msg_id GROUP BY 1""")
_view("error_events", (), "SELECT event_id AS seq, ts AS at, 'email_processing' AS error_type FROM events WHERE event_type = 'error'")
_view("retrain_events", (), """
SELECT event_id AS seq, ts AS at, value > 20 AS success, CAST(event_id % 100 AS DOUBLE) / 100 AS accuracy
FROM events WHERE event_type = 'click'""")
_view("training_samples", ("messages",), """
SELECT CAST(m.msg_id AS STRING) AS sample_id, m.sender_email, m.sender_domain, m.subject, m.body,
  (l.toxic = 1 OR l.quality = 0) AS is_spam, CASE WHEN m.msg_id % 3 = 0 THEN 'user_feedback' END AS source
FROM messages m JOIN labels l ON l.doc_id = m.msg_id""")
# list items as people type them
_view("raw_items", (), """
SELECT CASE WHEN c_custkey % 3 = 0 THEN 'blacklist' ELSE 'whitelist' END AS list_type,
  CASE c_custkey % 8
    WHEN 0 THEN 'User' || k || '@Example.COM'
    WHEN 1 THEN '  shop' || k || '.example.org '
    WHEN 2 THEN 'https://www.site' || k || '.net/path/x'
    WHEN 3 THEN 'bad address' || k || '@'
    WHEN 4 THEN 'nodot' || k
    WHEN 5 THEN 'a.b+c' || k || '@mail.example.co.uk'
    WHEN 6 THEN 'HTTP://Upper' || k || '.COM'
    ELSE 'double@@x' || k || '.com' END AS raw_item
FROM (SELECT c_custkey, CAST(c_nationkey AS STRING) || CAST(c_custkey % 40 AS STRING) AS k FROM customer) c""")


def with_views(*names: str) -> str:
    """'WITH a AS (...), b AS (...) ' for the named views and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n"


_loaded: dict[str, str] = {}


def load_tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the given tables as temporary views, once per session and folder."""
    app = spark.sparkContext.applicationId
    if _loaded.get(app) == sf_dir:
        return
    _loaded[app] = sf_dir
    for name in TABLES:
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "documents":
            frame = spread(frame)
        frame.createOrReplaceTempView(name)


def spread(frame: DataFrame) -> DataFrame:
    """Use every core on an input with fewer splits than cores, such as one file with one row group.

    Large inputs have many more splits than cores and are left alone: no shuffle of texts.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores * 2) if frame.rdd.getNumPartitions() < cores else frame


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    load_tables(spark, sf_dir)
    frame = spark.sql(with_views(name) + f"SELECT * FROM {name}")
    return as_engine_messages(frame) if name == "messages" else frame


def as_engine_messages(frame: DataFrame) -> DataFrame:
    """Flat header columns -> raw_headers."""

    def one(column: str) -> Column:
        return F.array(F.col(column))

    received = F.array_repeat(F.lit("from relay by mx; Mon, 1 Jan 2024 00:00:00 +0000"), F.col("hdr_received_hops"))
    return frame.withColumn("raw_headers", F.create_map(
        F.lit("Authentication-Results"), one("hdr_auth_results"),
        F.lit("List-Unsubscribe"), one("hdr_list_unsubscribe"),
        F.lit("Reply-To"), one("hdr_reply_to"),
        F.lit("Return-Path"), one("hdr_return_path"),
        F.lit("Message-ID"), one("hdr_message_id"),
        F.lit("Received"), received,
    )).withColumn("received_at", F.col("received_at").cast("timestamp_ntz")).withColumn("folder", F.lit("INBOX")).drop(
        "hdr_auth_results", "hdr_list_unsubscribe", "hdr_reply_to", "hdr_return_path", "hdr_message_id", "hdr_received_hops")
