"""Scores, verdicts, and the text exchanged with an external scorer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.functions import features as ft
from mailsieve.functions import fixed_values as fv
from mailsieve.functions import text as tx

# Features the marketing score reads.
MARKETING_INPUTS = tuple(n for names, _, _ in fv.MARKETING_WEIGHTS for n in names) + (
    "content_html_tag_count", "has_list_unsubscribe")
VERDICT = "struct<action:string,reason:string,confidence:double,method:string>"


def verdict(action: Column | str, reason: Column | str, confidence: Column | float, method: Column | str) -> Column:
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        as_col(action).alias("action"), as_col(reason).alias("reason"),
        as_col(confidence).cast("double").alias("confidence"), as_col(method).alias("method"),
    )


def spam_or_keep(is_spam: Column) -> Column:
    return F.when(is_spam, "SPAM").otherwise("KEEP")


def marketing_score() -> Column:
    """Capped weighted sum over marketing features, at most 1."""
    score = F.lit(0.0)
    for names, weight, cap in fv.MARKETING_WEIGHTS:
        hits = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        score = score + F.least(hits.cast("double") * F.lit(weight), F.lit(cap))
    score = score + F.when(F.col("content_html_tag_count") > fv.MARKETING_HTML_TAGS, fv.MARKETING_HTML_BONUS).otherwise(0.0)
    score = score + F.when(F.col("has_list_unsubscribe") > 0, fv.MARKETING_UNSUBSCRIBE_BONUS).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def ml_verdict(p_spam: Column, marketing: Column, config: EngineConfig, failed: Column | None = None) -> Column:
    """Forest first, then marketing for forest ham.

    NULL ``p_spam`` means that no model was there; ``failed`` marks rows on which scoring broke.
    """
    is_spam = p_spam > 0.5
    confidence = F.when(is_spam, p_spam).otherwise(1.0 - p_spam)

    def two_digits(col: Column) -> Column:
        return F.format_string("%.2f", col)

    forest = verdict(
        spam_or_keep(is_spam),
        F.concat(F.lit("ML: "), F.when(is_spam, "Spam").otherwise("Ham"), F.lit(" (conf: "), two_digits(confidence), F.lit(")")),
        confidence, "ml_random_forest")
    promoted = verdict(
        "SPAM", F.concat(F.lit("ML: Marketing content detected (score: "), two_digits(marketing), F.lit(")")),
        marketing, "ml_marketing")
    missing = verdict("KEEP", "ML model not available or trained", 0.5, "ml_unavailable")
    broken = verdict("KEEP", "ML error", 0.5, "ml_error")
    chain = F.when(F.lit(False) if failed is None else failed, broken).when(p_spam.isNull(), missing)
    if config.classify_marketing_as_spam:
        chain = chain.when(~is_spam & (marketing >= config.marketing_confidence_threshold), promoted)
    return chain.otherwise(forest)


def mismatched_brand(subject: Column, sender_email: Column, brands: Sequence[str] = fv.BRANDS) -> Column:
    """First brand named in the subject that the sender address does not carry; NULL if none.

    A filter over a constant array: a chain of 39 conditions would outgrow generated code.
    """
    known = F.array(*[F.struct(
        F.lit(b).alias("name"), F.lit(b.replace(" ", "")).alias("joined"),
        F.lit(b.replace(" ", "").replace("-", "")).alias("bare")) for b in brands])

    def first_of(mail: Column) -> Column:
        hits = F.filter(known, lambda b: (F.contains(mail["s"], b["name"]) | F.contains(mail["s"], b["joined"]))
                        & ~F.contains(mail["a"], b["bare"]))
        return F.get(hits, F.lit(0))["name"]

    lowered = F.struct(F.lower(tx.or_empty(subject)).alias("s"), F.lower(tx.or_empty(sender_email)).alias("a"))
    return tx.let(lowered, first_of)


def header_signals(sender_email: Column) -> dict[str, Column]:
    """What the header summary of a prompt says, as columns."""
    addr = F.lower(tx.or_empty(sender_email))

    def foreign(name: str) -> Column:
        value = F.lower(ft.header(name))
        return F.when((value != "") & ~F.contains(addr, value), "yes").otherwise("no")

    return {
        "auth_snippet": F.substring(ft.header("Authentication-Results"), 1, fv.PROMPT_AUTH_CHARS),
        "list_unsubscribe": F.when(ft.header("List-Unsubscribe") != "", "present").otherwise("absent"),
        "reply_to_mismatch": foreign("Reply-To"),
        "return_path_mismatch": foreign("Return-Path"),
    }


def scorer_prompt(sender_email: Column, subject: Column, body: Column, has_headers: bool = True,
                  brands: Sequence[str] = fv.BRANDS) -> Column:
    """The text an external scorer gets; lines that have nothing to say are left out."""
    addr, subj, text = tx.or_empty(sender_email), tx.or_empty(subject), tx.or_empty(body)
    domain = F.lower(F.substring_index(addr, "@", -1))
    brand = mismatched_brand(subj, addr, brands)
    lines = [
        F.when(addr != "", F.concat(F.lit("From: "), addr)),
        F.when(F.contains(addr, F.lit("@")) & (domain != ""), F.concat(F.lit("Sender Domain: "), domain)),
        F.when(subj != "", F.concat(F.lit("Subject: "), subj)),
        F.when((subj != "") & brand.isNotNull(), F.concat(
            F.lit("⚠️ BRAND MISMATCH: Subject mentions '"), brand, F.lit("' but sender is "), addr)),
        F.when(text != "", F.concat(F.lit("Content: "), F.when(
            F.length(text) > fv.PROMPT_BODY_CHARS,
            F.concat(F.substring(text, 1, fv.PROMPT_BODY_CHARS), F.lit(fv.PROMPT_TRUNCATED))).otherwise(text))),
    ]
    if has_headers:
        sig = header_signals(sender_email)
        lines.append(F.when(F.size(F.col("raw_headers")) > 0, F.concat(
            F.lit("Headers: Auth="), sig["auth_snippet"],
            F.lit(" | List-Unsubscribe="), sig["list_unsubscribe"],
            F.lit(" | ReplyToMismatch="), sig["reply_to_mismatch"],
            F.lit(" | ReturnPathMismatch="), sig["return_path_mismatch"])))
    return F.concat_ws("\n", *lines)


def parse_verdict(reply: Column, provider: str) -> Column:
    """Verdict struct from a scorer's raw reply.

    A JSON object is read field by field; other JSON is an error; text that is no JSON is spam if it
    says so in words.
    """
    method, prefix, yes_word = fv.PROVIDERS[provider.lower()]
    text = tx.strip(reply)
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)

    def field(name: str, as_type: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", as_type)

    said = field("is_spam", "string")
    spam = F.when(F.schema_of_variant(field("is_spam", "variant")) == "STRING", said != "").otherwise(
        field("is_spam", "boolean"))
    given = field("confidence", "variant")
    number = field("confidence", "double")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.5))))
    structured = verdict(
        spam_or_keep(F.coalesce(spam, F.lit(False))),
        F.concat(F.lit(f"{prefix}: "), F.coalesce(field("reason", "string"), F.lit("LLM analysis"))),
        confidence, method)
    low = F.lower(text)
    free = verdict(
        spam_or_keep(F.contains(low, F.lit("spam")) | F.contains(low, F.lit(yes_word))),
        F.concat(F.lit(f"{prefix}: "), F.substring(text, 1, 100)), 0.7, method)
    unusable = ~F.startswith(kind, F.lit("OBJECT")) | (given.isNotNull() & number.isNull())
    return F.when(parsed.isNull(), free).when(unusable, scorer_error(provider, F.lit("reply is no verdict object"))).otherwise(
        structured)


def choose_provider(configured: str, available: Sequence[str]) -> str | None:
    """The configured provider if it is available, else the first available one; case does not matter."""
    usable = [p for p in fv.PROVIDERS if p in {a.lower() for a in available}]
    return configured.lower() if configured.lower() in usable else next(iter(usable), None)


def scorer_error(provider: str, error: Column) -> Column:
    """Verdict for a failed call: keep the mail."""
    method, prefix, _ = fv.PROVIDERS[provider.lower()]
    return verdict("KEEP", F.concat(F.lit(f"{prefix} error: "), F.substring(error, 1, 50)), 0.5, f"{method}_error")


UNAVAILABLE = ("KEEP", "No LLM API keys configured", 0.5, "llm_unavailable")
DEFAULT = ("KEEP", "Uncertain classification, keeping email", 0.5, "default")
