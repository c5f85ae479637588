"""Queries over sources, lists, verdicts, the cascade and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.feature_queries import AS_OF, as_of, feature_ctes, marketing_sql_expr, q
from catalog.fixtures import SQL_ADDRESS, view, with_views
from mailsieve.config import EngineConfig
from mailsieve.functions import addresses as ad
from mailsieve.functions import fixed_values as fv
from mailsieve.functions import identity
from mailsieve.functions import scoring as sc
from mailsieve.operators import cascade, lists, maintenance, verdicts
from mailsieve.operators.scorer_calls import CallRules
from mailsieve.plans.jobs import decision_facts
from mailsieve.plans.session import new_path
from mailsieve.sources import mail, mailbox, tables

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


FP = "md5(sender_email || subject || substring(body, 1, 200))"


def with_fingerprint(messages: DataFrame) -> DataFrame:
    return messages.withColumn("fingerprint", identity.fingerprint(F.col("sender_email"), F.col("subject"), F.col("body")))


# sources

@query(with_views("messages") + """SELECT CAST(msg_id AS VARCHAR) AS id, 'Sender ' || account || ' <' || sender_email || '>' AS sender,
  sender_email, sender_domain, 'Message ' || CAST(msg_id AS VARCHAR) AS subject, md5(body) AS body_md5,
  strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received, CAST(hdr_received_hops AS BIGINT) AS hops FROM messages""")
def ingest_mail(spark: SparkSession, sf: str) -> DataFrame:
    """Write every message out as mail bytes and read it back."""
    raw = _mail_texts(spark, sf).select(F.col("msg_id").alias("id"), F.encode("mail_text", "UTF-8").alias("content"))
    return _ingested(mail.parse_mail(raw), "id")


def _mail_texts(spark: SparkSession, sf: str) -> DataFrame:
    m = view(spark, sf, "messages")
    day = F.element_at(F.array(*[F.lit(d) for d in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]),
                       F.month("received_at"))
    date = F.concat(F.date_format("received_at", "d"), F.lit(" "), day, F.date_format("received_at", " yyyy HH:mm:ss"), F.lit(" +0200"))
    hops = F.array_join(F.transform(F.col("raw_headers")["Received"], lambda r: F.concat(F.lit("Received: "), r, F.lit("\n"))), "")
    head = F.concat(
        F.lit("From: Sender "), F.col("account"), F.lit(" <"), F.col("sender_email"), F.lit(">\nSubject: Message "), F.col("msg_id").cast("string"),
        F.lit("\nDate: "), date, F.lit("\n"), hops)
    plain = F.lit('Content-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n')
    simple = F.concat(head, plain, F.col("body"))
    multi = F.concat(
        head, F.lit('Content-Type: multipart/alternative; boundary="=-cut-here-="\n\n--=-cut-here-=\n'), plain, F.col("body"),
        F.lit("\n--=-cut-here-=\nContent-Type: text/html\n\n<p>other</p>\n--=-cut-here-=--\n"))
    return m.withColumn("mail_text", F.when(F.col("was_unread"), simple).otherwise(multi))


def _ingested(parsed: DataFrame, message_id: str | Column, *more: str) -> DataFrame:
    return mail.good_mail(parsed).withColumn("id", F.col(message_id) if isinstance(message_id, str) else message_id).select(
        "id", "sender", "sender_email", "sender_domain", "subject", F.md5("body").alias("body_md5"),
        F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received"),
        F.coalesce(F.size(F.col("raw_headers")["Received"]), F.lit(0)).cast("bigint").alias("hops"), *more)


@query(with_views("messages") + """SELECT CAST(msg_id AS VARCHAR) AS id, 'Sender ' || account || ' <' || sender_email || '>' AS sender,
  sender_email, sender_domain, 'Message ' || CAST(msg_id AS VARCHAR) AS subject,
  md5(CASE WHEN was_unread THEN body || chr(10) ELSE body END) AS body_md5,
  strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received, CAST(hdr_received_hops AS BIGINT) AS hops, was_unread FROM messages""")
def ingest_mailboxes(spark: SparkSession, sf: str) -> DataFrame:
    """Write all messages into mailboxes, quoting lines that look like separators, and read them by byte ranges."""
    day = F.date_format("received_at", "EEE MMM d HH:mm:ss yyyy")
    status = F.when(F.col("was_unread"), "Status: O\n").otherwise("Status: RO\n")
    quoted = F.regexp_replace(F.concat(status, "mail_text"), "(?m)^(>*From )", ">$1")
    path = new_path(spark, "mailboxes")
    _mail_texts(spark, sf).select(F.concat(F.lit("From sender@list "), day, F.lit("\n"), quoted, F.lit("\n"))).write.text(path)
    raw = mailbox.read_mailboxes(spark, path, partition_bytes=4 << 20)
    return _ingested(mailbox.ingest_mailboxes(raw), F.element_at(F.split("subject", " "), 2), "was_unread")


_SENDERS = """senders AS (SELECT msg_id, CASE msg_id % 5 WHEN 0 THEN 'A. User <' || sender_email || '>' WHEN 1 THEN '  ' || sender_email || ' '
  WHEN 2 THEN 'Undisclosed' WHEN 3 THEN '<X@a@b.Org> "<' || sender_email || '>"' ELSE sender_email END AS sender FROM messages)"""


@query(with_views("messages") + ", " + _SENDERS + """, a AS (SELECT msg_id, CASE WHEN regexp_extract(sender, '<([^\\n]+?)>', 1) <> ''
  THEN regexp_extract(sender, '<([^\\n]+?)>', 1) WHEN contains(sender, '@') THEN trim(sender) ELSE '' END AS sender_email FROM senders)
  SELECT msg_id, sender_email, CASE WHEN contains(sender_email, '@') THEN split_part(sender_email, '@', -1) ELSE '' END AS sender_domain FROM a""")
def extract_address(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "messages")
    senders = spark.sql(with_views("messages") + ", " + _SENDERS + " SELECT * FROM senders")
    address = ad.extract_address(F.col("sender"))
    return senders.select("msg_id", address.alias("sender_email"), ad.sender_domain(address).alias("sender_domain"))


@query(with_views("messages") + "SELECT msg_id, account, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received FROM messages WHERE was_unread")
def unread_only(spark: SparkSession, sf: str) -> DataFrame:
    m = mail.newest_first(mail.unread_only(view(spark, sf, "messages")))
    return m.select("msg_id", "account", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received"))


_IDS = """ids AS (SELECT doc_id AS msg_id, CASE doc_id % 4 WHEN 0 THEN 'x' || CAST(doc_id AS STRING) WHEN 1 THEN '-' || CAST(doc_id AS STRING)
  WHEN 2 THEN '' ELSE CAST(doc_id AS STRING) END AS id FROM documents)"""


@query(f"WITH {_IDS} SELECT msg_id, id FROM ids WHERE regexp_full_match(id, '[0-9]+')")
def valid_ids(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "messages")
    return mail.valid_ids(spark.sql(f"WITH {_IDS} SELECT * FROM ids"))


@query(with_views("raw_items") + """SELECT trim(raw_item) AS raw_item, CASE WHEN contains(raw_item, '@') THEN 'email' ELSE 'domain' END AS item_type
  FROM raw_items WHERE trim(raw_item) <> ''""")
def list_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tables.list_lines(view(spark, sf, "raw_items").select(F.col("raw_item").alias("value")))


# normalised list items in SQL
_ADDR_RE = q(SQL_ADDRESS)
_HOST = "split_part(regexp_replace(lower(trim(raw_item)), '^https?://', ''), '/', 1)"
_ITEMS = f"""items AS (SELECT list_type, raw_item, CASE WHEN contains(raw_item, '@') THEN 'email' ELSE 'domain' END AS item_type,
  CASE WHEN contains(raw_item, '@') THEN CASE WHEN regexp_matches(trim(raw_item), {_ADDR_RE}) THEN lower(trim(raw_item)) END
       ELSE CASE WHEN contains({_HOST}, '.') THEN {_HOST} END END AS item FROM raw_items)"""


@query(with_views("raw_items") + f", {_ITEMS} SELECT list_type, item_type, item FROM items WHERE list_type = 'whitelist' AND item IS NOT NULL GROUP BY ALL ORDER BY ALL")
def read_exported_list(spark: SparkSession, sf: str) -> DataFrame:
    """Export form and back: rows to JSON, JSON to rows."""
    current = lists.valid_items(view(spark, sf, "raw_items")).select(*lists.LIST_COLUMNS).distinct()
    exported = tables.list_rows_json(current, "whitelist")
    return exported.select(F.from_json("value", "item_type string, item string").alias("v")).select(
        F.lit("whitelist").alias("list_type"), "v.item_type", "v.item")


@query(with_views("raw_items") + f", {_ITEMS} SELECT list_type, item_type, item FROM items WHERE item IS NOT NULL GROUP BY ALL")
def export_list_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Both lists written by export_list and read by read_list_json: one as rows, one as a document."""
    current = lists.valid_items(view(spark, sf, "raw_items")).select(*lists.LIST_COLUMNS).distinct()
    back = []
    for list_type, one in (("whitelist", False), ("blacklist", True)):
        path = new_path(spark, "export")
        tables.export_list(current, list_type, path, one_document=one)
        back.append(tables.read_list_json(spark, path, list_type))
    return back[0].unionByName(back[1])


@query(with_views("verdict_cache") + f"""SELECT fingerprint, action, method, confidence FROM verdict_cache
  WHERE cached_at IS NULL OR date_diff('microsecond', cached_at, TIMESTAMP '{AS_OF}') <= 30 * 86400000000""")
def live_verdict_cache(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.live_cache(view(spark, sf, "verdict_cache"), 30, as_of()).select("fingerprint", "action", "method", "confidence")


@query(with_views("verdict_cache", "feedback") + """, fresh AS (SELECT fingerprint, CASE WHEN feedback_type = 'is_spam' THEN 'SPAM' ELSE 'KEEP' END AS action,
  'user_feedback' AS method, row_number() OVER (PARTITION BY fingerprint ORDER BY CASE WHEN feedback_type = 'is_spam' THEN 3 ELSE 2 END DESC, seq) AS rn
  FROM feedback WHERE feedback_type IN ('not_spam', 'is_spam'))
  SELECT fingerprint, action, method FROM fresh WHERE rn = 1
  UNION ALL SELECT fingerprint, action, method FROM verdict_cache WHERE fingerprint NOT IN (SELECT fingerprint FROM fresh)""")
def write_verdict_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The cache after a feedback run: overrides replace older entries."""
    merged = verdicts.merge_cache(_cache(spark, sf), _overrides(spark, sf))
    return merged.select("fingerprint", "action", "method")


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "verdict_cache").withColumns({
        "override": F.lit(False), "cached_at": F.col("cached_at").cast("timestamp_ntz")}).select(*verdicts.CACHE_COLUMNS)


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    from mailsieve.operators import feedback as fb
    rows = view(spark, sf, "feedback").withColumn("handled", fb.handling_order(F.col("feedback_type"), F.col("seq")))
    return verdicts.feedback_overrides(rows)


_BROKEN = """stored AS (SELECT sample_id, sender_email, is_spam, CASE WHEN sender_domain = 'gmail.com' THEN 'cut'
  WHEN sender_domain = 'free.fr' THEN 'no label' WHEN sender_domain = 'cheap.ml' THEN 'no mail' ELSE 'good' END AS state FROM training_samples)"""


@query(with_views("training_samples") + f", {_BROKEN} SELECT sample_id, sender_email, is_spam FROM stored WHERE state = 'good'")
def read_training_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Stored samples, some cut off, some without label or mail."""
    samples = view(spark, sf, "training_samples")
    good = F.to_json(F.struct(F.struct("sender_email", "sender_domain", "subject", "body").alias("email_data"), "is_spam", "source"))
    value = (
        F.when(F.col("sender_domain") == "gmail.com", F.substring(good, 1, 60))
        .when(F.col("sender_domain") == "free.fr", F.to_json(F.struct(F.struct("sender_email", "body").alias("email_data"))))
        .when(F.col("sender_domain") == "cheap.ml", F.to_json(F.struct("is_spam")))
        .otherwise(good))
    lines = samples.select("sample_id", value.alias("value"))
    return tables.parse_training_samples(lines).select("sample_id", "sender_email", "is_spam")


# lists

@query(with_views("raw_items") + f", {_ITEMS} SELECT list_type, raw_item, item_type, item, item IS NOT NULL AS valid FROM items")
def normalize_items(spark: SparkSession, sf: str) -> DataFrame:
    return lists.classify_items(view(spark, sf, "raw_items")).withColumn("valid", F.col("item").isNotNull())


@query(with_views("raw_items", "sender_list") + f""", {_ITEMS} SELECT list_type, item_type, item FROM sender_list
  UNION SELECT list_type, item_type, item FROM items WHERE item IS NOT NULL""")
def list_add(spark: SparkSession, sf: str) -> DataFrame:
    return lists.add_items(view(spark, sf, "sender_list"), view(spark, sf, "raw_items"))


def _full_list(spark: SparkSession, sf: str) -> DataFrame:
    return lists.add_items(view(spark, sf, "sender_list"), view(spark, sf, "raw_items"))


_FULL = f"""{_ITEMS}, full_list AS (SELECT list_type, item_type, item FROM sender_list
  UNION SELECT list_type, item_type, item FROM items WHERE item IS NOT NULL)"""
# removals: the blacklisted raw items, asked for on both lists
_GONE = """gone AS (SELECT l.list_type, i.item_type, i.item FROM items i, (VALUES ('whitelist'), ('blacklist')) AS l(list_type)
  WHERE i.list_type = 'blacklist' AND i.item IS NOT NULL GROUP BY ALL)"""


def _removals(spark: SparkSession, sf: str) -> DataFrame:
    asked = view(spark, sf, "raw_items").filter("list_type = 'blacklist'").select("raw_item")
    return asked.withColumn("list_type", F.explode(F.array(F.lit("whitelist"), F.lit("blacklist"))))


@query(with_views("raw_items", "sender_list") + f", {_FULL}, {_GONE} SELECT * FROM full_list EXCEPT SELECT list_type, item_type, item FROM gone")
def list_remove(spark: SparkSession, sf: str) -> DataFrame:
    return lists.remove_items(_full_list(spark, sf), _removals(spark, sf))


@query(with_views("raw_items", "sender_list") + f""", {_FULL}, {_GONE} SELECT g.list_type, g.item_type, g.item, f.item IS NOT NULL AS found
  FROM gone g LEFT JOIN full_list f ON f.list_type = g.list_type AND f.item_type = g.item_type AND f.item = g.item""")
def list_removal_report(spark: SparkSession, sf: str) -> DataFrame:
    return lists.removal_report(_full_list(spark, sf), _removals(spark, sf))


@query(with_views("raw_items", "sender_list") + f", {_FULL} SELECT item_type, item FROM full_list WHERE list_type = 'blacklist'")
def list_contents(spark: SparkSession, sf: str) -> DataFrame:
    return lists.list_contents(_full_list(spark, sf), "blacklist")


@query(with_views("raw_items", "sender_list") + f""", {_FULL} SELECT k.list_type, k.item_type, count(f.item) AS items
  FROM (VALUES ('whitelist', 'email'), ('whitelist', 'domain'), ('blacklist', 'email'), ('blacklist', 'domain')) AS k(list_type, item_type)
  LEFT JOIN full_list f ON f.list_type = k.list_type AND f.item_type = k.item_type GROUP BY ALL""")
def list_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lists.list_counts(_full_list(spark, sf))


@query(with_views("raw_items", "sender_list") + f", {_FULL} SELECT * FROM full_list WHERE list_type <> 'blacklist'")
def list_clear(spark: SparkSession, sf: str) -> DataFrame:
    return lists.clear_list(_full_list(spark, sf), "blacklist", confirm=True)


@query(with_views("raw_items", "sender_list") + f""", {_ITEMS} SELECT list_type, item_type, item FROM sender_list WHERE list_type <> 'whitelist'
  UNION SELECT 'whitelist', item_type, item FROM items WHERE item IS NOT NULL""")
def list_import_replace(spark: SparkSession, sf: str) -> DataFrame:
    return lists.import_items(view(spark, sf, "sender_list"), view(spark, sf, "raw_items").select("raw_item"), "whitelist", replace=True)[0]


@query(with_views("raw_items", "sender_list") + f", {_ITEMS} SELECT 'blacklist' AS list_type, raw_item, item_type FROM items WHERE item IS NULL")
def list_import_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return lists.import_items(view(spark, sf, "sender_list"), view(spark, sf, "raw_items").select("raw_item"), "blacklist")[1].select(
        "list_type", "raw_item", "item_type")


def _list_reason(list_type: str, word: str) -> str:
    return f"""CASE WHEN EXISTS (SELECT 1 FROM sender_list l WHERE l.list_type = '{list_type}' AND l.item_type = 'email' AND l.item = lower(m.sender_email))
      THEN 'Email ''' || lower(m.sender_email) || ''' is {word}'
    WHEN EXISTS (SELECT 1 FROM sender_list l WHERE l.list_type = '{list_type}' AND l.item_type = 'domain' AND l.item = lower(m.sender_domain))
      THEN 'Domain ''' || lower(m.sender_domain) || ''' is {word}' END"""


@query(with_views("messages", "sender_list") + f", r AS (SELECT msg_id, {_list_reason('whitelist', 'whitelisted')} AS whitelist_reason FROM messages m) SELECT * FROM r WHERE whitelist_reason IS NOT NULL")
def match_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return lists.match_whitelist(view(spark, sf, "messages").select("msg_id", "sender_email", "sender_domain"), view(spark, sf, "sender_list")).select(
        "msg_id", "whitelist_reason")


@query(with_views("messages", "sender_list") + f", r AS (SELECT msg_id, {_list_reason('blacklist', 'blacklisted')} AS blacklist_reason FROM messages m) SELECT * FROM r WHERE blacklist_reason IS NOT NULL")
def match_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    return lists.match_blacklist(view(spark, sf, "messages").select("msg_id", "sender_email", "sender_domain"), view(spark, sf, "sender_list")).select(
        "msg_id", "blacklist_reason")


@query(with_views("messages", "sender_list") + f"SELECT msg_id FROM messages m WHERE {_list_reason('blacklist', 'blacklisted')} IS NULL")
def not_already_listed(spark: SparkSession, sf: str) -> DataFrame:
    return lists.not_already_listed(
        view(spark, sf, "messages").select("msg_id", "sender_email", "sender_domain"), view(spark, sf, "sender_list"), "blacklist").select("msg_id")


# fingerprints, overrides, deduplication

@query(with_views("messages") + f"SELECT msg_id, {FP} AS fingerprint FROM messages")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return with_fingerprint(view(spark, sf, "messages")).select("msg_id", "fingerprint")


@query(with_views("feedback") + """, r AS (SELECT fingerprint, CASE WHEN feedback_type = 'is_spam' THEN 'SPAM' ELSE 'KEEP' END AS action,
  CASE WHEN feedback_type = 'is_spam' THEN 'User feedback: is spam' ELSE 'User feedback: not spam' END AS reason,
  row_number() OVER (PARTITION BY fingerprint ORDER BY CASE WHEN feedback_type = 'is_spam' THEN 3 ELSE 2 END DESC, seq) AS rn
  FROM feedback WHERE feedback_type IN ('not_spam', 'is_spam'))
  SELECT fingerprint, action, reason, CAST(1 AS DOUBLE) AS confidence, 'user_feedback' AS method FROM r WHERE rn = 1""")
def set_override(spark: SparkSession, sf: str) -> DataFrame:
    return _overrides(spark, sf).select("fingerprint", "action", "reason", "confidence", "method")


@query(with_views("messages", "verdict_cache") + f"""SELECT m.msg_id, c.action, c.reason || ' (user feedback)' AS reason FROM messages m
  JOIN verdict_cache c ON c.fingerprint = {FP} WHERE c.method = 'user_feedback'""")
def apply_override(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade_stage(spark, sf, EngineConfig()).filter("method = 'user_feedback'").select("msg_id", "action", "reason")


@query(with_views("messages", "verdict_cache") + f"""SELECT m.msg_id, c.action, c.reason || ' (cached)' AS reason, c.method, c.confidence FROM messages m
  JOIN verdict_cache c ON c.fingerprint = {FP} WHERE c.method <> 'user_feedback'""")
def apply_cached_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade_stage(spark, sf, EngineConfig()).filter("reason LIKE '%(cached)'").select("msg_id", "action", "reason", "method", "confidence")


def _cascade_stage(spark: SparkSession, sf: str, config: EngineConfig) -> DataFrame:
    """Messages run through the stages with empty lists and an unsure forest: only stored verdicts decide."""
    frame = with_fingerprint(view(spark, sf, "messages")).select(
        "msg_id", "sender_email", "sender_domain", "fingerprint", F.lit(0.5).alias("p_spam"), F.lit(0.0).alias("marketing_score"))
    nobody = spark.createDataFrame([], lists.LIST_SCHEMA)
    staged = cascade.stage_verdicts(frame, nobody, _cache(spark, sf), config)
    return staged.filter("decision IS NOT NULL").select("msg_id", "decision.*")


@query(with_views("decisions") + """, r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) AS rn FROM decisions)
  SELECT fingerprint, seq, action, method, confidence FROM r WHERE rn = 1""")
def dedup_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.dedup_decisions(view(spark, sf, "decisions")).select("fingerprint", "seq", "action", "method", "confidence")


# scores and the cascade

_ML = f"""m AS (SELECT f.msg_id, f.sender_email, f.sender_domain, f.subject, f.body, s.p_spam, {marketing_sql_expr()} AS mk
  FROM feats f JOIN model_scores s ON s.msg_id = f.msg_id),
ml AS (SELECT *, CASE WHEN p_spam > 0.5 OR mk >= 0.6 THEN 'SPAM' ELSE 'KEEP' END AS ml_action,
  CASE WHEN p_spam > 0.5 THEN p_spam WHEN mk >= 0.6 THEN mk ELSE 1 - p_spam END AS ml_confidence,
  CASE WHEN p_spam <= 0.5 AND mk >= 0.6 THEN 'ml_marketing' ELSE 'ml_random_forest' END AS ml_method FROM m)"""


def _ml_ctes(*more: str) -> str:
    """feature CTEs plus further views, then m and ml."""
    extra = with_views(*more)[5:]
    extra = ",\n".join(part for part in _split_ctes(extra) if not part.startswith(("messages AS", "feedback AS", "feedback_base AS")))
    return feature_ctes() + (",\n" + extra if extra else "") + ",\n" + _ML


def _split_ctes(text: str) -> list[str]:
    parts, depth, current, quoted = [], 0, "", False
    for ch in text:
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                parts.append(current.strip())
                current = ""
                continue
        current += ch
    return parts + [current.strip()]


def scored_frame(spark: SparkSession, sf: str, keep=("msg_id", "account", "folder", "was_unread", "subject", "sender_email", "sender_domain"),
                 with_prompt: bool = False) -> DataFrame:
    """Narrow rows with marketing score and the stand-in forest score."""
    frame = cascade.detection_frame(
        view(spark, sf, "messages"), as_of=as_of(), keep=keep, groups=("subject", "content", "newsletter", "headers"), with_prompt=with_prompt)
    names = [*keep, "fingerprint", "marketing_score", *(["prompt"] if with_prompt else [])]
    return frame.select(*names).join(view(spark, sf, "model_scores"), "msg_id")


@query(_ml_ctes("model_scores") + " SELECT msg_id, ml_action AS action, round(ml_confidence, 6) AS confidence, ml_method AS method FROM ml")
def ml_verdict(spark: SparkSession, sf: str) -> DataFrame:
    ml = sc.ml_verdict(F.col("p_spam"), F.col("marketing_score"), EngineConfig())
    return scored_frame(spark, sf).withColumn("v", ml).select(
        "msg_id", "v.action", F.round("v.confidence", 6).alias("confidence"), "v.method")


@query(_ml_ctes("model_scores") + " SELECT msg_id, ml_action AS action, ml_method AS method FROM ml WHERE ml_confidence > 0.8")
def accept_if_confident(spark: SparkSession, sf: str) -> DataFrame:
    ml = sc.ml_verdict(F.col("p_spam"), F.col("marketing_score"), EngineConfig())
    return scored_frame(spark, sf).withColumn("v", ml).filter(cascade.accept_if_confident(F.col("v"), EngineConfig())).select(
        "msg_id", "v.action", "v.method")


_BRAND = "list_filter(" + "[" + ", ".join(q(b) for b in fv.BRANDS) + "]" + """, lambda b: (contains(lower(subject), b) OR contains(lower(subject), replace(b, ' ', '')))
  AND NOT contains(lower(sender_email), replace(replace(b, ' ', ''), '-', '')))[1]"""


@query(with_views("messages") + f"SELECT msg_id, {_BRAND} AS brand FROM messages WHERE {_BRAND} IS NOT NULL")
def brand_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    m = view(spark, sf, "messages").select("msg_id", sc.mismatched_brand(F.col("subject"), F.col("sender_email")).alias("brand"))
    return m.filter("brand IS NOT NULL")


_SIGNALS = """substring(coalesce(hdr_auth_results, ''), 1, 300) AS auth_snippet,
  CASE WHEN hdr_list_unsubscribe IS NOT NULL THEN 'present' ELSE 'absent' END AS list_unsubscribe,
  CASE WHEN hdr_reply_to IS NOT NULL AND NOT contains(sender_email, hdr_reply_to) THEN 'yes' ELSE 'no' END AS reply_to_mismatch,
  CASE WHEN hdr_return_path IS NOT NULL AND NOT contains(sender_email, hdr_return_path) THEN 'yes' ELSE 'no' END AS return_path_mismatch"""


@query(with_views("messages") + f"SELECT msg_id, {_SIGNALS} FROM messages")
def header_signals(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "messages").select("msg_id", *[c.alias(n) for n, c in sc.header_signals(F.col("sender_email")).items()])


_PROMPT = f"""'From: ' || sender_email || chr(10) || 'Sender Domain: ' || split_part(lower(sender_email), '@', -1)
  || CASE WHEN subject <> '' THEN chr(10) || 'Subject: ' || subject ELSE '' END
  || CASE WHEN subject <> '' AND {_BRAND} IS NOT NULL THEN chr(10) || '⚠️ BRAND MISMATCH: Subject mentions ''' || {_BRAND} || ''' but sender is ' || sender_email ELSE '' END
  || CASE WHEN body = '' THEN '' WHEN length(body) > 2000 THEN chr(10) || 'Content: ' || substring(body, 1, 2000) || '... [truncated]'
     ELSE chr(10) || 'Content: ' || body END
  || chr(10) || 'Headers: Auth=' || auth_snippet || ' | List-Unsubscribe=' || list_unsubscribe || ' | ReplyToMismatch=' || reply_to_mismatch
  || ' | ReturnPathMismatch=' || return_path_mismatch"""
_PROMPTS = f"prompts AS (SELECT msg_id, {_PROMPT} AS prompt FROM (SELECT *, {_SIGNALS} FROM messages))"


@query(with_views("messages") + f", {_PROMPTS} SELECT msg_id, length(prompt) AS prompt_length, md5(prompt) AS prompt_md5 FROM prompts")
def scorer_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = sc.scorer_prompt(F.col("sender_email"), F.col("subject"), F.col("body"))
    return view(spark, sf, "messages").select("msg_id", prompt.alias("p")).select(
        "msg_id", F.length("p").cast("bigint").alias("prompt_length"), F.md5("p").alias("prompt_md5"))


def _parse_sql(prefix: str, method: str, word: str) -> str:
    return f""", t AS (SELECT msg_id, trim(reply) AS reply, CASE WHEN json_valid(trim(reply)) THEN trim(reply) END AS j FROM verdict_text)
  SELECT msg_id, CASE WHEN j IS NOT NULL THEN CASE WHEN coalesce(CAST(json_extract(j, '$.is_spam') AS BOOLEAN), false) THEN 'SPAM' ELSE 'KEEP' END
     WHEN contains(lower(reply), 'spam') OR contains(lower(reply), '{word}') THEN 'SPAM' ELSE 'KEEP' END AS action,
   '{prefix}: ' || CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.reason'), 'LLM analysis') ELSE substring(reply, 1, 100) END AS reason,
   CASE WHEN j IS NOT NULL THEN greatest(0.0, least(1.0, coalesce(CAST(json_extract(j, '$.confidence') AS DOUBLE), 0.5))) ELSE 0.7 END AS confidence,
   '{method}' AS method FROM t"""


def _parse(provider: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return view(spark, sf, "verdict_text").select("msg_id", sc.parse_verdict(F.col("reply"), provider).alias("v")).select("msg_id", "v.*")
    return run


for _provider, (_method, _prefix, _word) in fv.PROVIDERS.items():
    QUERIES[f"parse_verdict_{_provider}"] = _parse(_provider)
    ORACLES[f"parse_verdict_{_provider}"] = with_views("verdict_text") + _parse_sql(_prefix, _method, _word)


def stub_scorer(prompts):
    """Deterministic stand-in for an external scorer: judges by words in the prompt."""
    return ['{"is_spam":true,"confidence":0.9,"reason":"bait"}' if "prize" in p.lower() else
            "cannot tell" if "password" in p.lower() else '{"is_spam":false,"confidence":0.6,"reason":"plain"}' for p in prompts]


_STUB = """scored AS (SELECT msg_id, CASE WHEN contains(lower(prompt), 'prize') THEN 'SPAM' ELSE 'KEEP' END AS s_action,
  CASE WHEN contains(lower(prompt), 'prize') THEN 'OpenAI: bait' WHEN contains(lower(prompt), 'password') THEN 'OpenAI: cannot tell' ELSE 'OpenAI: plain' END AS s_reason,
  CASE WHEN contains(lower(prompt), 'prize') THEN 0.9 WHEN contains(lower(prompt), 'password') THEN 0.7 ELSE 0.6 END AS s_confidence FROM prompts)"""


_SCORED_SQL = with_views("messages") + f""", {_PROMPTS}, {_STUB}, fps AS (SELECT {FP} AS fingerprint, msg_id FROM messages),
  firsts AS (SELECT f.fingerprint, min(p.prompt) AS prompt FROM fps f JOIN prompts p ON p.msg_id = f.msg_id GROUP BY 1),
  back AS (SELECT f.fingerprint, min(f.msg_id) AS msg_id FROM fps f JOIN prompts p ON p.msg_id = f.msg_id JOIN firsts x ON x.fingerprint = f.fingerprint AND x.prompt = p.prompt GROUP BY 1)
  SELECT b.fingerprint, s.s_action AS action, s.s_reason AS reason, CAST(s.s_confidence AS DOUBLE) AS confidence, 'llm_openai' AS method
  FROM back b JOIN scored s ON s.msg_id = b.msg_id"""


@query(_SCORED_SQL)
def external_score(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.external_score(_prompts(spark, sf), stub_scorer, "openai").select("fingerprint", "decision.*")


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return with_fingerprint(view(spark, sf, "messages")).select(
        "fingerprint", sc.scorer_prompt(F.col("sender_email"), F.col("subject"), F.col("body")).alias("prompt"))


def absent_scorer(prompts):
    raise RuntimeError("asked although the ledger has every reply")


@query(_SCORED_SQL)
def external_score_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """All prompts are scored with a ledger; the rows are those of a later run that has the ledger and no scorer."""
    calls = CallRules(ledger=new_path(spark, "ledger"))
    cascade.external_score(_prompts(spark, sf), stub_scorer, "openai", calls=calls).write.format("noop").mode("overwrite").save()
    return cascade.external_score(_prompts(spark, sf), absent_scorer, "openai", calls=calls).select("fingerprint", "decision.*")


_FLOW = f"""listed AS (SELECT m.msg_id, {_list_reason('whitelist', 'whitelisted')} AS wl, {_list_reason('blacklist', 'blacklisted')} AS bl FROM messages m),
flow AS (SELECT ml.msg_id, l.wl, l.bl, c.action AS c_action, c.reason AS c_reason, c.method AS c_method, c.confidence AS c_confidence,
  ml.ml_action, ml.ml_confidence, ml.ml_method, ml.p_spam, ml.mk
  FROM ml JOIN listed l ON l.msg_id = ml.msg_id
  LEFT JOIN verdict_cache c ON c.fingerprint = md5(ml.sender_email || ml.subject || substring(ml.body, 1, 200))),
staged AS (SELECT *, CASE WHEN wl IS NOT NULL THEN 'wl' WHEN bl IS NOT NULL THEN 'bl' WHEN c_method = 'user_feedback' THEN 'fb'
  WHEN ml_confidence > 0.8 THEN 'ml' WHEN c_method IS NOT NULL THEN 'cache' ELSE 'open' END AS stage FROM flow)"""
_ML_REASON = """CASE WHEN ml_method = 'ml_marketing' THEN 'ML: Marketing content detected (score: ' || printf('%.2f', mk) || ')'
  WHEN p_spam > 0.5 THEN 'ML: Spam (conf: ' || printf('%.2f', ml_confidence) || ')' ELSE 'ML: Ham (conf: ' || printf('%.2f', ml_confidence) || ')' END"""


def _flow_sql(open_action: str, open_reason: str, open_confidence: str, open_method: str) -> str:
    return f"""SELECT s.msg_id,
  CASE stage WHEN 'wl' THEN 'KEEP' WHEN 'bl' THEN 'SPAM' WHEN 'fb' THEN c_action WHEN 'ml' THEN ml_action WHEN 'cache' THEN c_action ELSE {open_action} END AS action,
  CASE stage WHEN 'wl' THEN 'WHITELIST: ' || wl WHEN 'bl' THEN 'BLACKLIST: ' || bl WHEN 'fb' THEN c_reason || ' (user feedback)'
    WHEN 'ml' THEN {_ML_REASON} WHEN 'cache' THEN c_reason || ' (cached)' ELSE {open_reason} END AS reason,
  round(CASE stage WHEN 'wl' THEN 1 WHEN 'bl' THEN 1 WHEN 'fb' THEN c_confidence WHEN 'ml' THEN ml_confidence WHEN 'cache' THEN c_confidence ELSE {open_confidence} END, 6) AS confidence,
  CASE stage WHEN 'wl' THEN 'whitelist' WHEN 'bl' THEN 'blacklist' WHEN 'fb' THEN 'user_feedback' WHEN 'ml' THEN ml_method WHEN 'cache' THEN c_method ELSE {open_method} END AS method"""


_CLASSIFY = (_ml_ctes("model_scores", "sender_list", "verdict_cache") + f", {_FLOW}, {_PROMPTS}, {_STUB}, classified AS ("
             + _flow_sql("s_action", "s_reason", "s_confidence", "'llm_openai'") + " FROM staged s JOIN scored p ON p.msg_id = s.msg_id)")


def decided(spark: SparkSession, sf: str, config: EngineConfig = EngineConfig(), scorer=stub_scorer) -> DataFrame:
    frame = scored_frame(spark, sf, with_prompt=config.use_scorer_for_uncertain)
    return cascade.classify(frame, view(spark, sf, "sender_list"), _cache(spark, sf), config=config, scorer=scorer)


@query(_CLASSIFY + " SELECT * FROM classified")
def classify(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade with stored scores, cache and a stub scorer."""
    return decided(spark, sf).select("msg_id", "action", "reason", F.round("confidence", 6).alias("confidence"), "method")


@query(_ml_ctes("model_scores", "sender_list", "verdict_cache") + f", {_FLOW} "
       + _flow_sql("'KEEP'", "'Uncertain classification, keeping email'", "0.5", "'default'").replace("WHEN c_method IS NOT NULL", "")
       .replace("WHEN 'cache' THEN c_action", "WHEN 'cache' THEN 'KEEP'").replace("WHEN 'cache' THEN c_reason || ' (cached)'", "WHEN 'cache' THEN 'Uncertain classification, keeping email'")
       .replace("WHEN 'cache' THEN c_confidence", "WHEN 'cache' THEN 0.5").replace("WHEN 'cache' THEN c_method", "WHEN 'cache' THEN 'default'") + " FROM staged s")
def classify_without_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """Scorer off: what is uncertain is kept by default."""
    out = decided(spark, sf, EngineConfig(use_scorer_for_uncertain=False), None)
    return out.select("msg_id", "action", "reason", F.round("confidence", 6).alias("confidence"), "method")


@query(_CLASSIFY + " SELECT method, action, count(*) AS messages FROM classified GROUP BY ALL")
def classified_methods(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).groupBy("method", "action").agg(F.count("*").alias("messages"))


@query(_CLASSIFY + f""", facts AS (SELECT {FP} AS fingerprint, m.msg_id, c.action, c.method FROM classified c JOIN messages m ON m.msg_id = c.msg_id),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY msg_id) AS rn FROM facts) WHERE rn = 1)
  SELECT method, action, count(*) AS decisions FROM firsts GROUP BY ALL""")
def detection_to_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of the cascade as facts, deduplicated and counted by method."""
    facts = decision_facts(cascade.route(decided(spark, sf), view(spark, sf, "accounts")), as_of(), 0.1)
    return verdicts.dedup_decisions(facts).groupBy("method", "action").agg(F.count("*").alias("decisions"))


@query(_CLASSIFY + """ SELECT c.msg_id, CASE WHEN c.action = 'SPAM' THEN CASE WHEN m.account = 'work' THEN 'spam' ELSE 'SPAM_AUTO' END ELSE 'INBOX' END AS target_folder,
  CASE WHEN c.action = 'SPAM' THEN true ELSE NOT m.was_unread END AS marked_read FROM classified c JOIN messages m ON m.msg_id = c.msg_id""")
def route(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.route(decided(spark, sf), view(spark, sf, "accounts")).select("msg_id", "target_folder", "marked_read")


@query(with_views("feedback") + """SELECT seq, CASE WHEN feedback_type IN ('whitelist', 'not_spam') THEN 'INBOX' WHEN account = 'work' THEN 'spam' ELSE 'SPAM_AUTO' END AS target_folder FROM feedback""")
def route_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.feedback_destination(view(spark, sf, "feedback"), view(spark, sf, "accounts")).select("seq", "target_folder")


_PURGED = f"""purged AS (SELECT msg_id, account FROM mailbox WHERE folder = CASE WHEN account = 'work' THEN 'spam' ELSE 'SPAM_AUTO' END
  AND CAST(received_at AS DATE) < DATE '2024-03-01' - 50)"""


@query(_CLASSIFY + ", " + with_views("mailbox")[5:].split("mailbox AS", 1)[1].join(["mailbox AS", ""]) + f""", {_PURGED}
  SELECT m.account, count(*) AS processed, count(*) FILTER (c.action = 'SPAM') AS spam_detected, count(*) FILTER (c.action = 'SPAM') AS spam_moved,
  CAST(0 AS BIGINT) AS errors, (SELECT count(*) FROM purged p WHERE p.account = m.account) AS cleanup_deleted
  FROM classified c JOIN messages m ON m.msg_id = c.msg_id GROUP BY 1""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    accounts = view(spark, sf, "accounts")
    gone = maintenance.old_spam(view(spark, sf, "mailbox"), 50, as_of(), accounts)
    return cascade.run_summary(cascade.route(decided(spark, sf), accounts), purged=gone)


@query(_CLASSIFY + """ SELECT c.msg_id, m.account, c.action, m.sender_email AS sender, substring(m.subject, 1, 30) AS subject, c.reason,
  substring(m.subject, 1, 50) AS detail_subject FROM classified c JOIN messages m ON m.msg_id = c.msg_id""")
def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.decision_log(decided(spark, sf))


# maintenance

@query(with_views("mailbox") + f", {_PURGED} SELECT msg_id, account FROM purged")
def purge_old_spam(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.old_spam(view(spark, sf, "mailbox"), 50, as_of(), view(spark, sf, "accounts")).select("msg_id", "account")


@query(with_views("mailbox") + f", {_PURGED} SELECT msg_id FROM mailbox WHERE msg_id NOT IN (SELECT msg_id FROM purged)")
def kept_after_purge(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.purge_old_spam(view(spark, sf, "mailbox"), 50, as_of(), view(spark, sf, "accounts"))[0].select("msg_id")
