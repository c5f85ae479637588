"""Feature queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import view, with_views
from mailsieve.functions import features as ft
from mailsieve.functions import fixed_values as fv
from mailsieve.operators import cascade
from mailsieve.operators import feedback as fb

AS_OF = "2024-03-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def rounded(frame: DataFrame, names) -> DataFrame:
    return frame.withColumns({n: F.round(F.col(n), 6) for n in names})


def history(spark: SparkSession, sf: str) -> DataFrame:
    return fb.sender_counters(view(spark, sf, "feedback"))


def _group(group: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        past = history(spark, sf) if group in ("history", "interaction") else None
        frame = ft.extract_features(view(spark, sf, "messages"), past, as_of=as_of(), groups=(group,))
        return rounded(frame, fv.FEATURE_GROUPS[group])
    return run


def all_features(spark: SparkSession, sf: str) -> DataFrame:
    frame = ft.extract_features(view(spark, sf, "messages"), history(spark, sf), as_of=as_of())
    return rounded(frame, fv.FEATURE_NAMES)


def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    frame = ft.extract_features(view(spark, sf, "messages"), history(spark, sf), as_of=as_of())
    return ft.to_vector(frame).select("msg_id", F.posexplode(vector_to_array("features")).alias("position", "value")).select(
        "msg_id", F.col("position").cast("bigint").alias("position"), F.round("value", 6).alias("value"))


def marketing(spark: SparkSession, sf: str) -> DataFrame:
    frame = cascade.detection_frame(
        view(spark, sf, "messages"), as_of=as_of(), keep=("msg_id",), groups=("subject", "content", "newsletter", "headers"))
    return frame.select("msg_id", F.round("marketing_score", 6).alias("marketing_score"))


# SQL

_WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINK = rf'[^\x{{9}}-\x{{d}}\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}<>"{{}}|\\^`\[\]]+'


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _total(col: str, values) -> str:
    return f"list_sum(list_transform({_list(values)}, lambda k: (length({col}) - length(replace({col}, k, ''))) // length(k)))"


def _present(col: str, values) -> str:
    return f"list_sum(list_transform({_list(values)}, lambda k: CASE WHEN contains({col}, k) THEN 1 ELSE 0 END))"


def _count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {q(pattern)}))"


def _has(col: str, text: str) -> str:
    return f"contains({col}, {q(text)})"


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


_URLS = f"regexp_extract_all(lbody, {q(f'https?://{_LINK}|www\\.{_LINK}')})"
_TAGS = "regexp_extract_all(body, '<[^>]+>')"
_NL = "(length(body) - length(replace(body, chr(10), '')))"
_ENDS = " OR ".join(f"ends_with(dom, {q(t)})" for t in fv.FEATURE_TLDS)
_DKIM = f"regexp_extract(auth, {q(r'd=([^;\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}]+)')}, 1)"
_MSGDOM = "lower(trim(split_part(hdr_message_id, '@', -1), '>'))"

EXPR = {
    "subject_length": "length(subj)",
    "subject_word_count": "len(swords)",
    "content_length": "length(body)",
    "content_word_count": "len(bwords)",
    "subject_to_content_ratio": _ratio("length(subj)", "length(body)"),
    "subject_caps_ratio": _ratio(r"length(regexp_replace(subj, '\P{Lu}', '', 'g'))", "length(subj)"),
    "subject_exclamation_count": _total("subj", ["!"]),
    "subject_question_count": _total("subj", ["?"]),
    **{f"subject_{c}_keywords": _present("lsubj", ks) for c, ks in fv.LEXICONS.items()},
    "subject_special_chars": _count("subj", "[!-/:-@\\[-`{-~]"),
    "subject_has_re": _flag("starts_with(lsubj, 're:') OR starts_with(lsubj, 'fwd:')"),
    "subject_has_brackets": _flag(f"{_has('subj', '[')} OR {_has('subj', ']')}"),
    "content_caps_ratio": _ratio(r"length(regexp_replace(body, '\P{Lu}', '', 'g'))", "length(body)"),
    "content_exclamation_count": _total("body", ["!"]),
    "content_question_count": _total("body", ["?"]),
    "content_url_count": f"len({_URLS})",
    "content_suspicious_tld_count": f"len(list_filter({_URLS}, lambda u: " + " OR ".join(f"contains(u, {q(t)})" for t in fv.FEATURE_TLDS) + "))",
    "content_email_count": _count("body", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    "content_phone_count": _count("body", r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"),
    "content_number_count": r"len(list_filter(regexp_extract_all(body, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{Nd}+')))",
    "content_line_count": f"CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END",
    "content_avg_line_length": "CASE WHEN body = '' THEN 0 ELSE list_avg(list_transform(string_split(body, chr(10)), lambda l: length(l))) END",
    **{f"content_{c}_keywords": _total("lbody", ks) for c, ks in fv.LEXICONS.items()},
    "content_html_tag_count": f"len({_TAGS})",
    "content_tracking_urls": _total("lbody", fv.TRACKING_TOKENS),
    "content_newsletter_phrases": _total("lbody", fv.NEWSLETTER_PHRASES),
    "content_image_count": " + ".join(_count("lbody", p) for p in (
        "<img[^>]*>", "src=['\"][^>]*['\"]", "alt=['\"][^>]*['\"]", r"\[image\]", r"\[logo\]", r"\[banner\]")),
    "content_social_links": _total("lbody", fv.SOCIAL_PHRASES),
    "content_cta_count": _total("lbody", fv.CTA_PHRASES),
    "content_price_indicators": " + ".join(_count("lbody", p) for p in (
        r"\p{Nd}+%\s*off", r"\$\p{Nd}+", "€\\p{Nd}+", "£\\p{Nd}+", "price", "cost", r"save \$", "discount", "% discount")),
    "sender_suspicious_tld": _flag(_ENDS),
    "sender_local_length": "length(local)",
    "sender_has_numbers": _flag(r"regexp_matches(local, '\p{Nd}')"),
    "sender_has_special_chars": _flag("regexp_matches(local, '[._+-]')"),
    "sender_domain_length": "length(dom)",
    "sender_legitimate_domain": _flag("dom IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com', 'aol.com')"),
    "auth_spf_pass": _flag(_has("auth", "spf=pass")),
    "auth_dkim_pass": _flag(_has("auth", "dkim=pass")),
    "auth_dmarc_pass": _flag(_has("auth", "dmarc=pass")),
    "from_dkim_domain_match": _flag(f"{_DKIM} <> '' AND ({_DKIM} = dom OR ends_with({_DKIM}, '.' || dom) OR ends_with(dom, '.' || {_DKIM}))"),
    "has_list_unsubscribe": _flag("coalesce(hdr_list_unsubscribe, '') <> ''"),
    "replyto_from_mismatch": _flag("coalesce(hdr_reply_to, '') <> '' AND NOT contains(addr, lower(hdr_reply_to))"),
    "message_id_domain_match": _flag(f"coalesce(contains(hdr_message_id, '@') AND {_MSGDOM} <> '' AND ends_with({_MSGDOM}, dom), false)"),
    "received_hops": "hdr_received_hops",
    "temporal_hour_of_day": "hour(received_at)",
    "temporal_day_of_week": "isodow(received_at) - 1",
    "temporal_is_weekend": _flag("isodow(received_at) >= 6"),
    "temporal_is_night_time": _flag("hour(received_at) >= 22 OR hour(received_at) < 6"),
    "temporal_is_business_hours": _flag("isodow(received_at) <= 5 AND hour(received_at) >= 9 AND hour(received_at) < 17"),
    "text_entropy": "coalesce(-st.h, 0)",
    "text_unique_word_ratio": "coalesce(st.d / CAST(st.n AS DOUBLE), 0)",
    "text_avg_word_length": "coalesce(st.l / CAST(st.n AS DOUBLE), 0)",
    "text_lexical_diversity": "coalesce(st.d / CAST(st.n AS DOUBLE), 0)",
    "text_repeated_words": "coalesce(st.r, 0)",
    "rich_html_to_text_ratio": _ratio(f"coalesce(list_sum(list_transform({_TAGS}, lambda t: length(t))), 0)", "length(body)"),
    "rich_has_images": _flag("regexp_matches(body, '(?i)<img[^>]*>')"),
    "rich_has_forms": _flag("regexp_matches(body, '(?i)<form[^>]*>')"),
    "rich_has_scripts": _flag("regexp_matches(body, '(?i)<script[^>]*>')"),
    "rich_link_density": _ratio(f"{_count('body', f'https?://{_LINK}')} * 100", "length(body)"),
}
HISTORY_EXPR = {
    "sender_spam_ratio": "CASE WHEN h.spam + h.ham > 0 THEN CAST(h.spam AS DOUBLE) / (h.spam + h.ham) ELSE 0 END",
    "sender_total_feedbacks": "coalesce(h.spam + h.ham, 0)",
    "sender_days_since_first": f"coalesce(floor(date_diff('microsecond', h.first_seen, TIMESTAMP '{AS_OF}') / 86400000000.0), 0)",
    "sender_is_recurring_spammer": _flag("h.spam >= 3"),
    "sender_is_recurring_ham": _flag("h.ham >= 3"),
}
INTERACTION_EXPR = {
    "interaction_marketing_newsletter": _flag("content_marketing_keywords > 0 AND content_newsletter_phrases > 0"),
    "interaction_suspicious_no_auth": _flag("content_suspicious_keywords > 0 AND auth_spf_pass + auth_dkim_pass + auth_dmarc_pass = 0"),
    "interaction_urgency_money": _flag("content_urgency_keywords > 0 AND content_money_keywords > 0"),
    "interaction_spammer_suspicious": _flag("sender_is_recurring_spammer = 1 AND content_suspicious_keywords > 0"),
    "interaction_shouting": _flag("subject_caps_ratio > 0.5 AND subject_exclamation_count > 2"),
}

_BASE = f"""prep AS (SELECT *, coalesce(subject, '') AS subj, lower(coalesce(subject, '')) AS lsubj, lower(body) AS lbody,
  lower(sender_email) AS addr, lower(sender_domain) AS dom, lower(coalesce(hdr_auth_results, '')) AS auth,
  CASE WHEN contains(sender_email, '@') THEN split_part(lower(sender_email), '@', 1) ELSE '' END AS local,
  list_filter(regexp_split_to_array(coalesce(subject, ''), {q(_WS + '+')}), lambda w: w <> '') AS swords,
  list_filter(regexp_split_to_array(body, {q(_WS + '+')}), lambda w: w <> '') AS bwords
  FROM messages)"""
_STATS = f"""word_rows AS (SELECT msg_id, unnest(list_filter(regexp_split_to_array(lsubj || ' ' || lbody, {q(_WS + '+')}), lambda w: w <> '')) AS w FROM prep),
word_counts AS (SELECT msg_id, w, count(*) AS c FROM word_rows GROUP BY ALL),
word_totals AS (SELECT msg_id, sum(c) AS n FROM word_counts GROUP BY ALL),
st AS (SELECT msg_id, max(n) AS n, count(*) AS d, sum(length(w) * c) AS l, count(*) FILTER (c > 3) AS r,
  sum(CAST(c AS DOUBLE) / n * log2(CAST(c AS DOUBLE) / n)) AS h FROM word_counts JOIN word_totals USING (msg_id) GROUP BY msg_id)"""
_HIST = """h AS (SELECT lower(sender_email) AS hkey, count(*) FILTER (feedback_type = 'is_spam') AS spam,
  count(*) FILTER (feedback_type = 'not_spam') AS ham, min(feedback.at) AS first_seen FROM feedback GROUP BY 1)"""


def feature_ctes() -> str:
    """CTEs up to ``feats``: msg_id and all 79 features as DOUBLE."""
    cols = {**EXPR, **HISTORY_EXPR}
    body = ",\n  ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in cols.items())
    inter = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in INTERACTION_EXPR.items())
    return (with_views("messages", "feedback") + f", {_BASE},\n{_STATS},\n{_HIST},\n"
            f"base_feats AS (SELECT prep.msg_id, prep.sender_email, prep.sender_domain, prep.subject, prep.body, {body}\n"
            f"FROM prep LEFT JOIN st ON st.msg_id = prep.msg_id LEFT JOIN h ON h.hkey = prep.addr),\n"
            f"feats AS (SELECT *, {inter} FROM base_feats)")


def _group_sql(group: str) -> str:
    names = fv.FEATURE_GROUPS[group]
    if group == "interaction" or group == "history":
        return feature_ctes() + " SELECT msg_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM feats"
    ctes = with_views("messages") + ", " + _BASE + (", " + _STATS if group == "text" else "")
    source = "prep LEFT JOIN st ON st.msg_id = prep.msg_id" if group == "text" else "prep"
    return ctes + " SELECT prep.msg_id AS msg_id, " + ", ".join(
        f"round(CAST({EXPR[n]} AS DOUBLE), 6) AS {n}" for n in names) + f" FROM {source}"


def marketing_sql_expr() -> str:
    parts = []
    for names, weight, cap in fv.MARKETING_WEIGHTS:
        parts.append(f"least(({' + '.join(names)}) * CAST({weight} AS DOUBLE), CAST({cap} AS DOUBLE))")
    parts.append("CASE WHEN content_html_tag_count > 10 THEN CAST(0.1 AS DOUBLE) ELSE 0 END")
    parts.append("CASE WHEN has_list_unsubscribe > 0 THEN CAST(0.15 AS DOUBLE) ELSE 0 END")
    return "least(" + " + ".join(parts) + ", 1.0)"


QUERIES = {f"features_{g}": _group(g) for g in fv.FEATURE_GROUPS}
QUERIES |= {"features_all": all_features, "feature_vector": feature_vector, "marketing_score": marketing}

ORACLES = {f"features_{g}": _group_sql(g) for g in fv.FEATURE_GROUPS}
ORACLES["features_all"] = feature_ctes() + " SELECT msg_id, " + ", ".join(
    f"round({n}, 6) AS {n}" for n in fv.FEATURE_NAMES) + " FROM feats"
ORACLES["feature_vector"] = feature_ctes() + " " + " UNION ALL ".join(
    f"SELECT msg_id, CAST({i} AS BIGINT) AS position, round({n}, 6) AS value FROM feats" for i, n in enumerate(fv.FEATURE_NAMES))
ORACLES["marketing_score"] = feature_ctes() + f" SELECT msg_id, round({marketing_sql_expr()}, 6) AS marketing_score FROM feats"
