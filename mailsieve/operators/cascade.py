"""The decision cascade as one pass over narrow rows.

Whitelist, blacklist, user override, forest with marketing score, cached verdict, external scorer,
default: in this order, the first stage with an answer decides. Everything up to the scorer is a chain
of conditions over one row, so no stage rescans the messages. Only the scorer runs in Python; it sees
the rows nothing else could decide, each distinct prompt once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.functions import features as ft
from mailsieve.functions import identity
from mailsieve.functions import scoring as sc
from mailsieve.functions import text as tx
from mailsieve.operators import lists, scorer_calls, verdicts
from mailsieve.operators.scorer_calls import CallRules, Scorer
from mailsieve.plans.session import materialize

DECISION_COLUMNS = ("action", "reason", "confidence", "method")


def detection_frame(messages: DataFrame, history: DataFrame | None = None, *, config: EngineConfig = EngineConfig(),
                    as_of: Column | None = None, keep: Sequence[str] = ("msg_id", "sender_email", "sender_domain"),
                    groups: Sequence[str] = ft.ALL_GROUPS, with_prompt: bool = False) -> DataFrame:
    """Messages -> narrow rows: keep columns, fingerprint, features, marketing score, and at most one
    bounded prompt. Bodies stay in the scan stage."""
    body = F.coalesce(F.col("body"), F.col("text_content")) if "text_content" in messages.columns else F.col("body")
    extra = {"fingerprint": F.col("fingerprint") if "fingerprint" in messages.columns else identity.fingerprint(
        F.col("sender_email"), F.col("subject"), body)}
    if with_prompt:
        extra["prompt"] = sc.scorer_prompt(
            F.col("sender_email"), F.col("subject"), body, "raw_headers" in messages.columns, config.brands)
    frame = ft.extract_features(
        messages.withColumns(extra), history, as_of=as_of, keep=[*keep, *extra], groups=groups,
        lexicons=config.lexicons, compat_zero_days=config.compat_zero_days)
    return frame.withColumn("marketing_score", sc.marketing_score())


def stage_verdicts(frame: DataFrame, sender_list: DataFrame, cache: DataFrame | None, config: EngineConfig) -> DataFrame:
    """Add ``decision``: the verdict of the first stage before the scorer that has one, else NULL.

    ``frame`` needs sender_email, sender_domain, fingerprint, p_spam and marketing_score.
    """
    failed = F.col("ml_failed") if "ml_failed" in frame.columns else None
    frame = lists.match_lists(frame, sender_list).withColumn(
        "_ml", sc.ml_verdict(F.col("p_spam"), F.col("marketing_score"), config, failed))
    listed = F.col("whitelist_reason").isNotNull() | F.col("blacklist_reason").isNotNull()
    if "prompt" in frame.columns:  # not carried through the join for rows that are decided without it
        frame = frame.withColumn("prompt", F.when(~listed & ~accept_if_confident(F.col("_ml"), config), F.col("prompt")))
    if cache is None:
        frame = frame.withColumn("_c", F.lit(None).cast("struct<action:string,reason:string,confidence:double,method:string,override:boolean>"))
    else:
        side = cache.select(F.col("fingerprint").alias("_cfp"), F.struct(
            "action", "reason", F.col("confidence").cast("double").alias("confidence"), "method", "override").alias("_c"))
        frame = frame.join(side, F.col("fingerprint") == F.col("_cfp"), "left").drop("_cfp")
    cached = F.col("_c")

    def stored(suffix: str) -> Column:
        return sc.verdict(cached["action"], F.concat(cached["reason"], F.lit(suffix)), cached["confidence"], cached["method"])

    chain = (
        F.when(F.col("whitelist_reason").isNotNull(), sc.verdict(
            "KEEP", F.concat(F.lit("WHITELIST: "), F.col("whitelist_reason")), 1.0, "whitelist"))
        .when(F.col("blacklist_reason").isNotNull(), sc.verdict(
            "SPAM", F.concat(F.lit("BLACKLIST: "), F.col("blacklist_reason")), 1.0, "blacklist"))
        .when(cached.isNotNull() & verdicts.is_override(cached["method"], cached["override"]), stored(" (user feedback)"))
        .when(accept_if_confident(F.col("_ml"), config), F.col("_ml"))
    )
    if config.use_scorer_for_uncertain:
        chain = chain.when(cached.isNotNull(), stored(" (cached)"))
    else:
        chain = chain.otherwise(sc.verdict(*sc.DEFAULT))
    return frame.withColumn("decision", chain).drop("_c", "_ml", "whitelist_reason", "blacklist_reason")


def accept_if_confident(ml: Column, config: EngineConfig) -> Column:
    """Strictly above the threshold; a marketing verdict below it goes on to the scorer."""
    return ml["confidence"] > config.ml_confidence_threshold


def external_score(pending: DataFrame, scorer: Scorer | None, provider: str = "openai", concurrency: int | None = None,
                   calls: CallRules = CallRules()) -> DataFrame:
    """(fingerprint, prompt) rows -> one verdict per distinct fingerprint.

    ``calls`` tells how calls are cut, spaced, repeated and kept; ``concurrency`` overrides its number of partitions.
    A call that fails for good is made again with halves of its prompts, so that only the prompts that fail by
    themselves get error verdicts; the job never fails.
    """
    if scorer is None:
        return pending.groupBy("fingerprint").agg(F.first(sc.verdict(*sc.UNAVAILABLE)).alias("decision"))
    found = scorer_calls.replies(pending, scorer, replace(calls, concurrency=concurrency or calls.concurrency))
    decision = F.when(F.col("reply").isNull(), sc.scorer_error(provider, F.coalesce("error", F.lit("no reply")))).otherwise(
        sc.parse_verdict(F.col("reply"), provider))
    return found.select("fingerprint", decision.alias("decision"))


def classify(frame: DataFrame, sender_list: DataFrame, cache: DataFrame | None = None, *,
             config: EngineConfig = EngineConfig(), scorer: Scorer | None = None, provider: str = "openai",
             replies: DataFrame | None = None, concurrency: int | None = None, calls: CallRules = CallRules()) -> DataFrame:
    """One decision per row of ``frame``.

    The open rows are scored by ``scorer``, or from ``replies`` (fingerprint, reply) collected elsewhere. A fingerprint
    covers the start of a text only, so rows that share one can differ in their prompts; the scorer is asked by prompt, and
    a row gets the verdict on its own. In a ledger such replies stand under the digest of the prompt.
    With a scorer the staged rows are written to the shared folder first, so that scans and features run
    once and an executor lost during scoring costs no recomputation of them.
    """
    staged = stage_verdicts(frame, sender_list, cache, config)
    if not config.use_scorer_for_uncertain:
        return _flatten(staged)
    if replies is not None:
        side = replies.select(F.col("fingerprint").alias("_rfp"), sc.parse_verdict(F.col("reply"), provider).alias("_scored"))
        staged = staged.join(side, F.col("fingerprint") == F.col("_rfp"), "left").drop("_rfp")
        missing = sc.scorer_error(provider, F.lit("no reply"))
        return _flatten(staged.withColumn("decision", F.coalesce("decision", "_scored", missing)).drop("_scored"))
    if scorer is None:
        return _flatten(staged.withColumn("decision", F.coalesce("decision", sc.verdict(*sc.UNAVAILABLE))))
    staged = materialize(staged.withColumn("prompt", F.when(F.col("decision").isNull(), F.col("prompt"))), "staged")
    asked = F.when(F.col("decision").isNull(), F.md5(tx.or_empty(F.col("prompt"))))
    scored = materialize(
        external_score(staged.filter("decision IS NULL").select(asked.alias("fingerprint"), "prompt"), scorer, provider, concurrency, calls), "scored")
    side = scored.select(F.col("fingerprint").alias("_asked"), F.col("decision").alias("_scored"))
    joined = staged.join(side, asked == F.col("_asked"), "left").drop("_asked")
    return _flatten(joined.withColumn("decision", F.coalesce("decision", "_scored")).drop("_scored"))


def _flatten(frame: DataFrame) -> DataFrame:
    names = [c for c in frame.columns if c not in ("decision", "prompt", *DECISION_COLUMNS)]
    return frame.select(*names, "decision.*")


def scorer_cache_entries(decisions: DataFrame, at: Column) -> DataFrame:
    """Fresh scorer verdicts as cache rows, one per fingerprint. What could not be judged is asked again next time."""
    judged = ~F.endswith("method", F.lit("_error")) & (F.col("method") != "llm_unavailable")
    fresh = decisions.filter(F.startswith("method", F.lit("llm_")) & judged & ~F.endswith("reason", F.lit(" (cached)")))
    rows = fresh.select("fingerprint", "action", "reason", "confidence", "method",
                        F.lit(False).alias("override"), at.alias("cached_at"))
    return verdicts.pick_row(rows, ["fingerprint"], F.col("action")).select(*verdicts.CACHE_COLUMNS)


def route(decisions: DataFrame, accounts: DataFrame, config: EngineConfig = EngineConfig(), folder: str = "folder") -> DataFrame:
    """Add ``target_folder`` and ``marked_read``: spam goes to the account's or the common spam folder and
    is read; kept mail stays where it is, as unread as it was."""
    side = accounts.select(F.col("name").alias("_acc"), "spam_folder")
    joined = decisions.join(side, F.col("account") == F.col("_acc"), "left").drop("_acc")
    spam = F.col("action") == "SPAM"
    return joined.withColumns({
        "target_folder": F.when(spam, F.coalesce("spam_folder", F.lit(config.spam_folder))).otherwise(F.col(folder)),
        "marked_read": read_flag(spam, F.col("was_unread")),
    }).drop("spam_folder")


def read_flag(spam: Column, was_unread: Column) -> Column:
    return F.when(spam, True).otherwise(~F.coalesce(was_unread, F.lit(False)))


def feedback_destination(feedback: DataFrame, accounts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Add ``target_folder``: confirmed ham to the inbox, confirmed spam to the spam folder."""
    side = accounts.select(F.col("name").alias("_acc"), "spam_folder")
    joined = feedback.join(side, F.col("account") == F.col("_acc"), "left").drop("_acc")
    spam = F.col("feedback_type").isin("blacklist", "is_spam")
    return joined.withColumn("target_folder", F.when(
        spam, F.coalesce("spam_folder", F.lit(config.spam_folder))).otherwise(config.inbox)).drop("spam_folder")


def run_summary(routed: DataFrame, errors: DataFrame | None = None, purged: DataFrame | None = None) -> DataFrame:
    """Per account: processed, spam_detected, spam_moved, errors, cleanup_deleted.

    ``errors`` and ``purged`` hold one row per failed or deleted message, with its account.
    """
    spam = F.col("action") == "SPAM"
    parts = routed.groupBy("account").agg(
        F.count("*").alias("processed"), F.count_if(spam).alias("spam_detected"),
        F.count_if(spam & (F.col("target_folder") != F.col("folder"))).alias("spam_moved"))
    for extra, name in ((errors, "errors"), (purged, "cleanup_deleted")):
        if extra is not None:
            parts = parts.unionByName(extra.groupBy("account").agg(F.count("*").alias(name)), allowMissingColumns=True)
        else:
            parts = parts.withColumn(name, F.lit(0).cast("bigint"))
    names = ("processed", "spam_detected", "spam_moved", "errors", "cleanup_deleted")
    return parts.groupBy("account").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def decision_log(decisions: DataFrame) -> DataFrame:
    """Short record per message for the log sink."""
    return decisions.select(
        "msg_id", "account", "action", F.col("sender_email").alias("sender"),
        F.substring(tx.or_empty(F.col("subject")), 1, 30).alias("subject"), "reason",
        F.substring(tx.or_empty(F.col("subject")), 1, 50).alias("detail_subject"))
