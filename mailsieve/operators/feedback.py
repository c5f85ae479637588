"""Learning from user feedback, as aggregates over the feedback facts.

Feedback rows: seq (unique message number), at, account, sender_email, sender_domain, feedback_type.
The handling order is folder by folder (whitelist, blacklist, not_spam, is_spam), newest first inside.
Each folder feeds one counter, so a running counter is a position inside (sender, folder) plus the
sender's totals of the folders before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.functions import addresses as ad
from mailsieve.functions import fixed_values as fv
from mailsieve.functions import text as tx
from mailsieve.operators import lists
from mailsieve.plans.session import materialize
from mailsieve.plans.skew import running_position

COUNTERS = {"is_spam": "spam_count", "not_spam": "ham_count", "whitelist": "whitelist_count", "blacklist": "blacklist_count"}
HISTORY_SCHEMA = (
    "sender_email string, sender_domain string, spam_count bigint, ham_count bigint, whitelist_count bigint, "
    "blacklist_count bigint, first_seen timestamp_ntz, last_seen timestamp_ntz")
# Rows of one sender and folder that are sorted together at most.
SEQ_BUCKET = 1_000_000


def feedback_type(folder: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Folder name -> feedback type, NULL for other folders."""
    chain = None
    for name, kind in config.feedback_folders:
        chain = F.when(folder == name, kind) if chain is None else chain.when(folder == name, kind)
    return chain


def folder_rank(kind: Column, config: EngineConfig = EngineConfig()) -> Column:
    chain = None
    for rank, (_, name) in enumerate(config.feedback_folders):
        chain = F.when(kind == name, rank) if chain is None else chain.when(kind == name, rank)
    return chain


def handling_order(kind: Column, seq: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Sortable position of a feedback in its run: folder rank, then newest first."""
    return F.struct(folder_rank(kind, config).alias("folder_rank"), (-seq).alias("newest_first"))


def from_folders(messages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Messages in feedback folders -> feedback rows with the handling order."""
    kinds = messages.withColumn("feedback_type", feedback_type(F.col("folder"), config))
    return kinds.filter(F.col("feedback_type").isNotNull()).withColumn(
        "folder_rank", folder_rank(F.col("feedback_type"), config))


def sender_counters(feedback: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """One row per lowercase sender: four counters, first and last time seen, merged with earlier state.

    Earlier state joins as more partial sums, so one map-side combined shuffle does both.
    """
    return _counters(feedback, prior).drop("new_spam", "new_ham")


def _counters(feedback: DataFrame, prior: DataFrame | None) -> DataFrame:
    """``sender_counters`` plus how many corrections this feedback holds (new_spam, new_ham)."""
    kind = F.col("feedback_type")
    fresh = feedback.select(
        F.lower(tx.or_empty(F.col("sender_email"))).alias("sender_email"),
        F.lower("sender_domain").alias("sender_domain"),
        *[(kind == name).cast("bigint").alias(column) for name, column in COUNTERS.items()],
        F.col("at").cast("timestamp_ntz").alias("first_seen"), F.col("at").cast("timestamp_ntz").alias("last_seen"),
        (kind == "is_spam").cast("bigint").alias("new_spam"), (kind == "not_spam").cast("bigint").alias("new_ham"),
    )
    if prior is not None:
        fresh = fresh.unionByName(prior.withColumns({"new_spam": F.lit(0).cast("bigint"), "new_ham": F.lit(0).cast("bigint")}).select(
            *fresh.columns))
    return fresh.groupBy("sender_email").agg(
        F.min("sender_domain").alias("sender_domain"),
        *[F.sum(name).alias(name) for name in (*COUNTERS.values(), "new_spam", "new_ham")],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def running_counters(feedback: DataFrame, prior: DataFrame | None = None, config: EngineConfig = EngineConfig(),
                     bucket_width: int = SEQ_BUCKET) -> DataFrame:
    """Each feedback with the sender's four counters as they stand right after it."""
    keyed = feedback.withColumns({
        "sender_key": F.lower(tx.or_empty(F.col("sender_email"))),
        "folder_rank": folder_rank(F.col("feedback_type"), config),
    })
    bucket = F.col("seq") - F.pmod("seq", F.lit(bucket_width))
    placed = running_position(
        keyed, ["sender_key", "feedback_type"], bucket, [F.col("seq").desc()], F.col("_bucket").desc(), "_position")
    totals = sender_counters(feedback).select(
        F.col("sender_email").alias("_tkey"), *[F.col(c).alias(f"_t_{c}") for c in COUNTERS.values()])
    joined = placed.join(totals, F.col("sender_key") == F.col("_tkey"))
    if prior is not None:
        joined = joined.join(prior.select(
            F.col("sender_email").alias("_pkey"), *[F.col(c).alias(f"_p_{c}") for c in COUNTERS.values()]),
            F.col("sender_key") == F.col("_pkey"), "left")
    ranks = {kind: rank for rank, (_, kind) in enumerate(config.feedback_folders)}
    for kind, name in COUNTERS.items():
        here = F.when(F.col("folder_rank") > ranks[kind], F.col(f"_t_{name}")).when(
            F.col("folder_rank") == ranks[kind], F.col("_position")).otherwise(0)
        if prior is not None:
            here = here + F.coalesce(F.col(f"_p_{name}"), F.lit(0))
        joined = joined.withColumn(name, here)
    return joined.select(*feedback.columns, "folder_rank", *COUNTERS.values())


def auto_action(counters: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Add should_blacklist, should_whitelist and auto_reason from the running counters."""
    spam = F.col("spam_count") + F.col("blacklist_count")
    ham = F.col("ham_count") + F.col("whitelist_count")
    return counters.withColumns({
        "should_blacklist": spam >= config.auto_blacklist_threshold,
        "should_whitelist": ham >= config.auto_whitelist_threshold,
        "auto_reason": F.when(ham >= config.auto_whitelist_threshold, F.concat(
            F.lit("Sender marked as legitimate "), ham.cast("string"), F.lit(" times")))
        .when(spam >= config.auto_blacklist_threshold, F.concat(
            F.lit("Sender marked as spam "), spam.cast("string"), F.lit(" times"))).otherwise(""),
    })


def whitelist_target(email: Column, domain: Column) -> Column:
    """struct(item_type, raw_item): the domain unless it is empty or a shared provider, in any case."""
    use_domain = (tx.or_empty(domain) != "") & ~F.lower(domain).isin(*fv.MAJOR_PROVIDERS)
    return _target(use_domain, email, domain)


def blacklist_target(email: Column, domain: Column, automatic: bool = False) -> Column:
    """struct(item_type, raw_item): the domain under a suspicious ending, else the address."""
    endings = fv.AUTO_BLACKLIST_TLDS if automatic else fv.BLACKLIST_TLDS
    return _target(tx.ends_with_any(F.lower(tx.or_empty(domain)), endings), email, domain)


def _target(use_domain: Column, email: Column, domain: Column) -> Column:
    return F.struct(
        F.when(use_domain, "domain").otherwise("email").alias("item_type"),
        F.when(use_domain, domain).otherwise(email).alias("raw_item"))


def _asked(feedback: DataFrame) -> DataFrame:
    """Whitelist/blacklist feedback with the list item it asks for."""
    email, domain, kind = F.col("sender_email"), F.col("sender_domain"), F.col("feedback_type")
    target = F.when(kind == "whitelist", whitelist_target(email, domain)).otherwise(blacklist_target(email, domain))
    return feedback.filter(kind.isin("whitelist", "blacklist")).withColumn("_t", target).select(
        *feedback.columns, kind.alias("list_type"), "_t.item_type", "_t.raw_item")


def explicit_targets(feedback: DataFrame) -> DataFrame:
    """Explicit feedback with the list item it asks for; ``item`` is NULL when that is invalid."""
    return _asked(feedback).withColumn("item", ad.normalize_item(F.col("raw_item"), F.col("item_type")))


def apply_explicit_feedback(feedback: DataFrame, current: DataFrame) -> DataFrame:
    """List with the items of explicit feedback inserted; invalid ones are in ``rejected_targets``.

    Requests are reduced to distinct senders, then to distinct items before they are checked, so targets are made
    once per sender and the check runs once per item, not once per feedback. Columns that are made by long
    expressions are so computed once, before the branches of the target use them.
    """
    senders = feedback.select("feedback_type", "sender_email", "sender_domain").filter(
        F.col("feedback_type").isin("whitelist", "blacklist")).distinct()
    asked = _asked(senders).groupBy("list_type", "item_type", F.lower("raw_item").alias("_l")).agg(
        F.min("raw_item").alias("raw_item"))
    fresh = asked.withColumn("item", ad.normalize_item(F.col("raw_item"), F.col("item_type"))).filter(
        F.col("item").isNotNull()).select(*lists.LIST_COLUMNS)
    return current.select(*lists.LIST_COLUMNS).unionByName(fresh).dropDuplicates(list(lists.LIST_COLUMNS))


def rejected_targets(feedback: DataFrame) -> DataFrame:
    return explicit_targets(feedback).filter(F.col("item").isNull()).drop("item")


def auto_list_items(feedback: DataFrame, current: DataFrame, prior: DataFrame | None = None,
                    config: EngineConfig = EngineConfig()) -> DataFrame:
    """List items that corrections add by themselves.

    Explicit feedback is handled before corrections, and an automatic insert can only hide inserts of the
    very same item. So whether a sender passes a threshold during the run is decided by its totals at the
    last correction, and one aggregate per sender replaces the row-by-row walk.
    """
    return _automatic(feedback, materialize(apply_explicit_feedback(feedback, current), "listed"), prior, config)


def _automatic(feedback: DataFrame, listed: DataFrame, prior: DataFrame | None, config: EngineConfig) -> DataFrame:
    spam = F.col("spam_count") + F.col("blacklist_count")
    ham = F.col("ham_count") + F.col("whitelist_count")
    email, domain = F.col("sender_email"), F.col("sender_domain")
    black = F.when((F.col("new_spam") > 0) & (spam >= config.auto_blacklist_threshold), F.struct(
        F.lit("blacklist").alias("list_type"), blacklist_target(email, domain, automatic=True).alias("target")))
    white = F.when((F.col("new_ham") > 0) & (ham >= config.auto_whitelist_threshold), F.struct(
        F.lit("whitelist").alias("list_type"), whitelist_target(email, domain).alias("target")))
    due = _counters(feedback, prior).select(
        "sender_email", "sender_domain", F.explode(F.array_compact(F.array(black, white))).alias("_e"))
    due = due.select("sender_email", "sender_domain", "_e.list_type", "_e.target.item_type", "_e.target.raw_item")
    fresh = lists.not_on_same_list(due, listed)
    return fresh.select("list_type", "item_type", ad.normalize_item(F.col("raw_item"), F.col("item_type")).alias("item")).filter(
        F.col("item").isNotNull()).distinct()


def apply_feedback(feedback: DataFrame, current: DataFrame, prior: DataFrame | None = None,
                   config: EngineConfig = EngineConfig()) -> DataFrame:
    """The sender list after a whole feedback run: explicit items, then automatic ones. The list between the two is
    written, as both read it, and so that no condition on its items is pushed back into the feedback's expressions."""
    listed = materialize(apply_explicit_feedback(feedback, current), "listed")
    return listed.unionByName(_automatic(feedback, listed, prior, config)).dropDuplicates(list(lists.LIST_COLUMNS))


def feedback_samples(feedback: DataFrame) -> DataFrame:
    """Every feedback is a training sample; blacklist and is_spam mean spam."""
    return feedback.withColumns({
        "is_spam": F.col("feedback_type").isin("blacklist", "is_spam"),
        "source": F.lit("user_feedback"),
    })


def failed_corrections(feedback: DataFrame, listed: DataFrame, prior: DataFrame | None = None,
                       config: EngineConfig = EngineConfig()) -> DataFrame:
    """Corrections that should have put their sender on a list but name an invalid item, with that item. Their
    counters, sample and override stay. ``listed`` is the list with the explicit feedback in it.

    Only feedback of senders that name an invalid item at all is counted row by row.
    """
    kind, email, domain = F.col("feedback_type"), F.col("sender_email"), F.col("sender_domain")
    target = F.when(kind == "not_spam", whitelist_target(email, domain)).when(
        kind == "is_spam", blacklist_target(email, domain, automatic=True))
    asked = feedback.withColumn("_t", target).withColumn(
        "_bad", F.col("_t").isNotNull() & ad.normalize_item(F.col("_t.raw_item"), F.col("_t.item_type")).isNull())
    asked = asked.withColumn("_key", F.lower(tx.or_empty(email)))
    suspects = asked.where("_bad").select("_key").distinct()
    if prior is not None:
        prior = prior.join(suspects, prior["sender_email"] == suspects["_key"], "left_semi")
    counted = auto_action(running_counters(asked.join(suspects, "_key", "left_semi"), prior, config), config)
    due = counted.where("_bad AND ((feedback_type = 'not_spam' AND should_whitelist) OR (feedback_type = 'is_spam' AND should_blacklist))")
    due = due.withColumn("list_type", F.when(kind == "not_spam", "whitelist").otherwise("blacklist"))
    return lists.not_on_same_list(due, listed).select(*feedback.columns, "list_type", "_t.item_type", "_t.raw_item")


def feedback_rejects(feedback: DataFrame, current: DataFrame, prior: DataFrame | None = None,
                     config: EngineConfig = EngineConfig()) -> DataFrame:
    """Feedback that counts as an error, with the invalid list item it names."""
    listed = apply_explicit_feedback(feedback, current)
    return rejected_targets(feedback).unionByName(failed_corrections(feedback, listed, prior, config))


def feedback_summary(feedback: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per account: processed, whitelist_added, blacklist_added (explicit only), correction_added, ml_samples,
    restored, errors. ``rejects`` (``feedback_rejects``) are errors and count nowhere else."""
    kind = F.col("feedback_type")
    rows = feedback.select("account", kind, F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        rejects.select("account", kind, F.lit(-1).alias("n"), F.lit(1).alias("e")))

    def added(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col("n"))), F.lit(0))

    return rows.groupBy("account").agg(
        F.sum("n").alias("processed"), added("whitelist").alias("whitelist_added"), added("blacklist").alias("blacklist_added"),
        added("not_spam", "is_spam").alias("correction_added"), F.sum("n").alias("ml_samples"), F.sum("n").alias("restored"),
        F.sum("e").alias("errors"))


def feedback_run_totals(summary: DataFrame) -> DataFrame:
    """One row over all accounts."""
    return summary.agg(
        F.count("*").alias("accounts_processed"),
        *[F.coalesce(F.sum(src), F.lit(0)).alias(f"total_{name}") for src, name in (
            ("processed", "feedback"), ("whitelist_added", "whitelist_added"), ("blacklist_added", "blacklist_added"),
            ("ml_samples", "ml_samples"), ("restored", "restored"), ("errors", "errors"))])
