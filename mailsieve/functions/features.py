"""The 79 message features as column expressions.

``extract_features`` reads each message once and returns narrow rows: the body never leaves the scan
stage. Derived texts (lowercase, words, tags, links) are computed in their own projections because many
features read them; the optimiser keeps such multiply-used projections apart, so nothing is recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions import fixed_values as fv
from mailsieve.functions import text as tx

# Fixed patterns. W is a word character, B a word boundary, S a whitespace character.
_W = f"[{fv.WORD_CHARS}]"
_B = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_S = fv.WHITESPACE
_LINK_CHARS = rf'[^{_S}<>"{{}}|\\^`\[\]]+'
URL = rf"https?://{_LINK_CHARS}|www\.{_LINK_CHARS}"
WEB_LINK = rf"https?://{_LINK_CHARS}"
_TLDS = rf"\.(?:{'|'.join(t.removeprefix('.') for t in fv.FEATURE_TLDS)})"  # one first character to look for
_LOCAL = "[A-Za-z0-9._%+-]"
# Tried once per run of local-part characters, at its first word boundary.
EMAIL = rf"(?:\G|(?<!{_LOCAL}))(?:(?!{_B}){_LOCAL})*+{_B}{_LOCAL}++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{_B}"
PHONE = rf"(?=[+(0-9])(\+?1[-.{_S}]?)?\(?[0-9]{{3}}\)?[-.{_S}]?[0-9]{{3}}[-.{_S}]?[0-9]{{4}}"
PHONE_TAIL = rf"[0-9]{{3}}[-.{_S}]?[0-9]{{4}}"  # how every phone number ends
NUMBER = rf"\p{{Nd}}(?<!{_W}\p{{Nd}})\p{{Nd}}*+(?!{_W})"
TAG = "<[^>]+>"
IMAGE_TAG = "<img[^>]*>"
QUOTED_SRC = "src=['\"][^>]*['\"]"
QUOTED_ALT = "alt=['\"][^>]*['\"]"
PERCENT_OFF = rf"(?<!\p{{Nd}})\p{{Nd}}++%[{_S}]*off"
AMOUNTS = {"$": r"\$\p{Nd}+", "€": "€\\p{Nd}+", "£": "£\\p{Nd}+"}
UPPERCASE = r"\p{IsUppercase}"
PUNCTUATION = r"\p{Punct}"
DKIM_DOMAIN = rf"d=([^;{_S}]+)"

# Groups that need nothing but the message itself.
MESSAGE_GROUPS = ("metadata", "subject", "content", "newsletter", "sender", "headers", "temporal", "text", "rich")
ALL_GROUPS = MESSAGE_GROUPS + ("history", "interaction")


def prepare(messages: DataFrame) -> DataFrame:
    """Add the derived texts the feature groups read. Unused ones are pruned by the optimiser."""
    body = F.col("body")
    if "text_content" in messages.columns:
        body = F.coalesce(body, F.col("text_content"))
    base = messages.withColumns({
        "_subj": tx.or_empty(F.col("subject")),
        "_body": tx.or_empty(body),
        "_addr": F.lower(tx.or_empty(F.col("sender_email"))),
        "_dom": F.lower(tx.or_empty(F.col("sender_domain"))),
    })
    lowered = base.withColumns({"_lsubj": F.lower("_subj"), "_lbody": F.lower("_body")})
    listed = lowered.withColumns({
        "_swords": tx.words(F.col("_lsubj")),
        "_bwords": tx.words(F.col("_lbody")),
        "_slen": F.length("_subj"),
        "_blen": F.length("_body"),
        # no tag ends after the last '>', and before it every '<' finds its end: both keep the search linear
        "_tail": F.length(F.substring_index("_body", ">", -1)),
        "_linked": F.contains("_lbody", F.lit("http")) | F.contains("_lbody", F.lit("www.")),
    })
    return listed.withColumns({
        "_words": F.sort_array(F.concat("_swords", "_bwords")),
        "_markup": F.substring(F.col("_body"), F.lit(1), F.col("_blen") - F.col("_tail")),
        "_links": F.when(F.col("_linked"), _links(F.col("_lbody"))).otherwise(F.array().cast("array<string>")),
    }).withColumn("_between", F.split("_markup", TAG, -1))  # one piece more than there are tags


def group_columns(group: str, columns: Sequence[str], lexicons: dict | None = None,
                  as_of: Column | None = None) -> dict[str, Column]:
    """name -> expression for one message-only group, over the columns of ``prepare``, ``_near`` and ``_wstat``."""
    lexicons = lexicons or fv.LEXICONS
    if group == "metadata":
        return _metadata()
    if group == "subject":
        return _subject(lexicons)
    if group == "content":
        return _content(lexicons)
    if group == "newsletter":
        return _newsletter()
    if group == "sender":
        return _sender()
    if group == "headers":
        return _headers(columns)
    if group == "temporal":
        return _temporal(as_of)
    if group == "text":
        return _text()
    if group == "rich":
        return _rich()
    raise ValueError(f"not a message-only feature group: {group}")


def extract_features(
    messages: DataFrame,
    history: DataFrame | None = None,
    *,
    as_of: Column | None = None,
    keep: Sequence[str] = ("msg_id",),
    groups: Sequence[str] = ALL_GROUPS,
    lexicons: dict | None = None,
    compat_zero_days: bool = False,
) -> DataFrame:
    """keep columns + the features of ``groups`` as DOUBLE columns.

    ``history`` holds one row per lowercase sender address. It is joined after the texts are gone, so
    the join moves numbers only.
    """
    wanted = [g for g in ALL_GROUPS if g in groups]
    needed = set(wanted) | ({"subject", "content", "newsletter", "headers", "history"}
                            if "interaction" in wanted else set())
    frame = prepare(messages)
    built: dict[str, Column] = {}
    for group in MESSAGE_GROUPS:
        if group in needed:
            built.update(group_columns(group, messages.columns, lexicons, as_of))
    phrases = _body_phrases(needed, lexicons or fv.LEXICONS)
    if phrases:
        frame = frame.withColumn("_near", tx.around_phrases(F.col("_lbody"), phrases))
    if "text" in needed:
        frame = frame.withColumn("_wstat", tx.word_statistics(F.col("_words")))
    frame = frame.select(
        *keep,
        *(["_addr"] if "history" in needed else []),
        *[expr.cast("double").alias(name) for name, expr in built.items()],
    )
    if "history" in needed:
        frame = add_history(frame, history, F.col("_addr"), as_of, compat_zero_days).drop("_addr")
    if "interaction" in wanted:
        frame = frame.withColumns(interaction_columns())
    names = [n for g in wanted for n in fv.FEATURE_GROUPS[g]]
    return frame.select(*keep, *names)


def add_history(frame: DataFrame, history: DataFrame | None, address: Column,
                as_of: Column | None = None, compat_zero_days: bool = False) -> DataFrame:
    """Left join the sender counters; an unknown sender gets zeros.

    No broadcast hint: the optimiser broadcasts the history only while its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold``, and above that splits a skewed sender at run time.
    """
    names = fv.FEATURE_GROUPS["history"]
    if history is None:
        return frame.withColumns({n: F.lit(0.0) for n in names})
    as_of = F.current_timestamp() if as_of is None else as_of
    spam, ham = F.col("spam_count"), F.col("ham_count")
    side = history.select(
        F.col("sender_email").alias("_hkey"),
        tx.ratio(spam.cast("double"), spam + ham).alias(names[0]),
        (spam + ham).cast("double").alias(names[1]),
        (F.lit(0.0) if compat_zero_days else whole_days(F.col("first_seen"), as_of)).alias(names[2]),
        tx.flag(spam >= 3).alias(names[3]),
        tx.flag(ham >= 3).alias(names[4]),
    )
    joined = frame.join(side, address == F.col("_hkey"), "left").drop("_hkey")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


def whole_days(since: Column, until: Column) -> Column:
    """Whole days between two timestamps, 0 when the first is unknown."""
    micros = F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.coalesce(F.floor(micros / F.lit(86_400_000_000)), F.lit(0)).cast("double")


def _metadata() -> dict[str, Column]:
    slen, blen = F.col("_slen"), F.col("_blen")
    return {
        "subject_length": slen,
        "subject_word_count": F.size("_swords"),
        "content_length": blen,
        "content_word_count": F.size("_bwords"),
        "subject_to_content_ratio": tx.ratio(slen, blen),
    }


def _subject(lexicons: dict) -> dict[str, Column]:
    subj, low = F.col("_subj"), F.col("_lsubj")
    out = {
        "subject_caps_ratio": tx.ratio(tx.matches(subj, UPPERCASE), F.col("_slen")),
        "subject_exclamation_count": tx.occurrences(subj, "!"),
        "subject_question_count": tx.occurrences(subj, "?"),
    }
    for category in fv.LEXICONS:
        out[f"subject_{category}_keywords"] = tx.phrases_present(low, lexicons[category])
    out["subject_special_chars"] = tx.matches(subj, PUNCTUATION)
    out["subject_has_re"] = tx.flag(F.startswith(low, F.lit("re:")) | F.startswith(low, F.lit("fwd:")))
    out["subject_has_brackets"] = tx.flag(F.contains(subj, F.lit("[")) | F.contains(subj, F.lit("]")))
    return out


def _links(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(URL), F.lit(0))


def _suspicious_links(low: Column, links: Column | None = None) -> Column:
    """Links of the lowercase text that have a suspicious ending anywhere inside."""
    return F.size(F.filter(_links(low) if links is None else links, lambda link: F.rlike(link, F.lit(_TLDS))))


def _email_addresses(body: Column) -> Column:
    """Number of addresses. None holds a blank, so only the pieces between blanks that have an @ are searched."""
    pieces = F.filter(F.split(body, " ", -1), lambda piece: F.contains(piece, F.lit("@")))
    return F.when(F.contains(body, F.lit("@")), tx.matches(F.array_join(pieces, " "), EMAIL)).otherwise(0)


def _body_phrases(groups: set[str], lexicons: dict) -> list[str]:
    """Every phrase that the columns of ``groups`` count in the lowercase body."""
    lists: list[Sequence[str]] = []
    if "content" in groups:
        lists += [lexicons[category] for category in fv.LEXICONS]
    if "newsletter" in groups:
        lists += [fv.TRACKING_TOKENS, fv.NEWSLETTER_PHRASES, fv.IMAGE_PLACEHOLDERS, fv.SOCIAL_PHRASES, fv.CTA_PHRASES, fv.PRICE_WORDS]
    return [phrase for phrases in lists for phrase in phrases]


def _content(lexicons: dict) -> dict[str, Column]:
    body, low, blen, links = F.col("_body"), F.col("_lbody"), F.col("_blen"), F.col("_links")
    near = F.col("_near")
    newlines = tx.occurrences(body, "\n")
    filled = blen > 0
    out = {
        "content_caps_ratio": tx.ratio(tx.matches(body, UPPERCASE), blen),
        "content_exclamation_count": tx.occurrences(body, "!"),
        "content_question_count": tx.occurrences(body, "?"),
        "content_url_count": F.size(links),
        "content_suspicious_tld_count": _suspicious_links(low, links),
        "content_email_count": _email_addresses(body),
        "content_phone_count": F.when(F.rlike(body, F.lit(PHONE_TAIL)), tx.matches(body, PHONE)).otherwise(0),
        "content_number_count": tx.matches(body, NUMBER),
        "content_line_count": F.when(filled, newlines + 1).otherwise(0),
        "content_avg_line_length": F.when(filled, (blen - newlines) / (newlines + 1)).otherwise(0.0),
    }
    for category in fv.LEXICONS:
        out[f"content_{category}_keywords"] = tx.total_occurrences(low, lexicons[category], near)
    out["content_html_tag_count"] = F.size("_between") - 1
    return out


def _newsletter() -> dict[str, Column]:
    low, near = F.col("_lbody"), F.col("_near")
    images = (
        F.when(F.size("_between") > 1, tx.matches(F.lower("_markup"), IMAGE_TAG)).otherwise(0)
        + tx.matches(low, QUOTED_SRC, "src=") + tx.matches(low, QUOTED_ALT, "alt=")
        + tx.total_occurrences(low, fv.IMAGE_PLACEHOLDERS, near))
    prices = tx.matches(low, PERCENT_OFF, "%") + tx.total_occurrences(low, fv.PRICE_WORDS, near)
    for sign, pattern in AMOUNTS.items():
        prices = prices + tx.matches(low, pattern, sign)
    return {
        "content_tracking_urls": tx.total_occurrences(low, fv.TRACKING_TOKENS, near),
        "content_newsletter_phrases": tx.total_occurrences(low, fv.NEWSLETTER_PHRASES, near),
        "content_image_count": images,
        "content_social_links": tx.total_occurrences(low, fv.SOCIAL_PHRASES, near),
        "content_cta_count": tx.total_occurrences(low, fv.CTA_PHRASES, near),
        "content_price_indicators": prices,
    }


def _sender() -> dict[str, Column]:
    addr, dom = F.col("_addr"), F.col("_dom")
    local = F.when(F.contains(addr, F.lit("@")), F.substring_index(addr, "@", 1)).otherwise("")
    return {
        "sender_suspicious_tld": tx.flag(tx.ends_with_any(dom, fv.FEATURE_TLDS)),
        "sender_local_length": F.length(local),
        "sender_has_numbers": tx.flag(F.rlike(local, F.lit(r"\p{Nd}"))),
        "sender_has_special_chars": tx.flag(F.rlike(local, F.lit(r"[._+\-]"))),
        "sender_domain_length": F.length(dom),
        "sender_legitimate_domain": tx.flag(dom.isin(*fv.LEGITIMATE_DOMAINS)),
    }


def header(name: str) -> Column:
    """All values of one header joined with '; ', '' when absent."""
    return tx.or_empty(F.array_join(F.col("raw_headers")[name], "; "))


def _headers(columns: Sequence[str]) -> dict[str, Column]:
    names = fv.FEATURE_GROUPS["headers"]
    if "raw_headers" not in columns:
        return {n: F.lit(0.0) for n in names}
    addr, dom = F.col("_addr"), F.col("_dom")
    auth = F.lower(header("Authentication-Results"))
    signed = F.regexp_extract(auth, DKIM_DOMAIN, 1)
    reply = F.lower(header("Reply-To"))
    message_id = header("Message-ID")
    id_domain = F.lower(F.trim(F.substring_index(message_id, "@", -1), F.lit(">")))
    received = F.col("raw_headers")["Received"]
    first = F.get(received, F.lit(0))
    return {
        names[0]: tx.flag(F.contains(auth, F.lit("spf=pass"))),
        names[1]: tx.flag(F.contains(auth, F.lit("dkim=pass"))),
        names[2]: tx.flag(F.contains(auth, F.lit("dmarc=pass"))),
        names[3]: tx.flag((signed != "") & (
            (signed == dom)
            | F.endswith(signed, F.concat(F.lit("."), dom))
            | F.endswith(dom, F.concat(F.lit("."), signed)))),
        names[4]: tx.flag(header("List-Unsubscribe") != ""),
        names[5]: tx.flag((reply != "") & ~F.contains(addr, reply)),
        names[6]: tx.flag(F.contains(message_id, F.lit("@")) & (id_domain != "") & F.endswith(id_domain, dom)),
        # several lines: their number; one line: its semicolons
        names[7]: F.when(received.isNull(), 0)
        .when(F.size(received) != 1, F.size(received))
        .when(tx.or_empty(first) == "", 1)
        .otherwise(tx.occurrences(first, ";")),
    }


def _temporal(as_of: Column | None) -> dict[str, Column]:
    at = F.col("received_at")
    at = F.coalesce(at, (F.current_timestamp() if as_of is None else as_of).cast("timestamp_ntz"))
    hour, day = F.hour(at), F.weekday(at)
    return {
        "temporal_hour_of_day": hour,
        "temporal_day_of_week": day,
        "temporal_is_weekend": tx.flag(day >= 5),
        "temporal_is_night_time": tx.flag((hour >= 22) | (hour < 6)),
        "temporal_is_business_hours": tx.flag((day < 5) & (hour >= 9) & (hour < 17)),
    }


def _text() -> dict[str, Column]:
    total, stat = F.size("_words"), F.col("_wstat")
    unique = tx.ratio(stat["distinct"], total)
    return {
        "text_entropy": F.when(total > 0, F.greatest(F.log2(total) - stat["clogc"] / total, F.lit(0.0))).otherwise(0.0),
        "text_unique_word_ratio": unique,
        "text_avg_word_length": tx.ratio(F.length(F.array_join("_words", "")), total),
        "text_lexical_diversity": unique,
        "text_repeated_words": stat["repeated"],
    }


def _rich() -> dict[str, Column]:
    body, blen = F.col("_body"), F.col("_blen")
    outside_tags = F.length(F.array_join("_between", "")) + F.col("_tail")

    def has_tag(name: str) -> Column:
        return tx.flag((F.size("_between") > 1) & F.rlike("_markup", F.lit(f"(?iu)<{name}[^>]*>")))

    return {
        "rich_html_to_text_ratio": tx.ratio(blen - outside_tags, blen),
        "rich_has_images": has_tag("img"),
        "rich_has_forms": has_tag("form"),
        "rich_has_scripts": has_tag("script"),
        "rich_link_density": tx.ratio(F.when(F.col("_linked"), tx.matches(body, WEB_LINK)).otherwise(0) * 100, blen),
    }


def interaction_columns() -> dict[str, Column]:
    def on(name: str) -> Column:
        return F.col(name) > 0

    unauthenticated = ~(on("auth_spf_pass") | on("auth_dkim_pass") | on("auth_dmarc_pass"))
    return {
        "interaction_marketing_newsletter": tx.flag(on("content_marketing_keywords") & on("content_newsletter_phrases")),
        "interaction_suspicious_no_auth": tx.flag(on("content_suspicious_keywords") & unauthenticated),
        "interaction_urgency_money": tx.flag(on("content_urgency_keywords") & on("content_money_keywords")),
        "interaction_spammer_suspicious": tx.flag(
            (F.col("sender_is_recurring_spammer") == 1.0) & on("content_suspicious_keywords")),
        "interaction_shouting": tx.flag((F.col("subject_caps_ratio") > 0.5) & (F.col("subject_exclamation_count") > 2)),
    }


def to_vector(features: DataFrame, output: str = "features") -> DataFrame:
    """Assemble the features in name order; a missing or NULL one counts as 0.0."""
    from pyspark.ml.feature import VectorAssembler

    have = set(features.columns)
    filled = features.withColumns({
        n: F.coalesce(F.col(n), F.lit(0.0)) if n in have else F.lit(0.0) for n in fv.FEATURE_NAMES
    })
    return VectorAssembler(inputCols=list(fv.FEATURE_NAMES), outputCol=output).transform(filled)
