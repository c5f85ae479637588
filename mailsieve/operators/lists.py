"""Sender lists: rows (list_type, item_type, item), each item once per list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions import addresses as ad
from mailsieve.functions import text as tx

LIST_COLUMNS = ("list_type", "item_type", "item")
LIST_SCHEMA = "list_type string, item_type string, item string"


def classify_items(items: DataFrame, kind: str = "auto") -> DataFrame:
    """Raw items -> + item_type and normalised item (NULL when invalid)."""
    if kind not in ("auto", "email", "domain"):
        raise ValueError(f"unknown item type: {kind}")
    kinds = ad.item_type(F.col("raw_item")) if kind == "auto" else F.lit(kind)
    return items.withColumn("item_type", kinds).withColumn(
        "item", ad.normalize_item(F.col("raw_item"), F.col("item_type")))


def valid_items(items: DataFrame, kind: str = "auto") -> DataFrame:
    return classify_items(items, kind).filter(F.col("item").isNotNull())


def rejected_items(items: DataFrame, kind: str = "auto") -> DataFrame:
    return classify_items(items, kind).filter(F.col("item").isNull()).drop("item")


def add_items(current: DataFrame, items: DataFrame, kind: str = "auto") -> DataFrame:
    """Set insert; ``items`` has list_type and raw_item. Invalid ones are left to ``rejected_items``."""
    fresh = valid_items(items, kind).select(*LIST_COLUMNS)
    return current.select(*LIST_COLUMNS).unionByName(fresh).dropDuplicates(list(LIST_COLUMNS))


def remove_items(current: DataFrame, items: DataFrame, kind: str = "auto") -> DataFrame:
    gone = valid_items(items, kind).select(*LIST_COLUMNS).distinct()
    return current.join(gone, list(LIST_COLUMNS), "left_anti")


def removal_report(current: DataFrame, items: DataFrame, kind: str = "auto") -> DataFrame:
    """Each requested removal with ``found`` true or false."""
    asked = valid_items(items, kind).select(*LIST_COLUMNS).distinct()
    present = current.select(*LIST_COLUMNS, F.lit(True).alias("found"))
    return asked.join(present, list(LIST_COLUMNS), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def import_items(current: DataFrame, items: DataFrame, list_type: str, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new list, rejected items). ``items`` has raw_item; invalid ones never fail the import."""
    if list_type not in ("whitelist", "blacklist"):
        raise ValueError(f"unknown list type: {list_type}")
    items = items.withColumn("list_type", F.lit(list_type))
    kept = current.filter(F.col("list_type") != list_type) if replace else current
    return add_items(kept, items), rejected_items(items)


def clear_list(current: DataFrame, list_type: str, confirm: bool = False) -> DataFrame:
    if not confirm:
        raise ValueError("clearing a list needs confirm=True")
    return current.filter(F.col("list_type") != list_type)


def list_contents(current: DataFrame, list_type: str) -> DataFrame:
    return current.filter(F.col("list_type") == list_type).select("item_type", "item").orderBy("item_type", "item")


def list_counts(current: DataFrame) -> DataFrame:
    """Items per list and kind, zeros included."""
    counts = current.groupBy("list_type", "item_type").agg(F.count("*").alias("n"))
    frame = current.sparkSession.createDataFrame(
        [(l, k) for l in ("whitelist", "blacklist") for k in ("email", "domain")], "list_type string, item_type string")
    return frame.join(counts, ["list_type", "item_type"], "left").withColumn("items", F.coalesce("n", F.lit(0))).drop("n")


def match_lists(messages: DataFrame, current: DataFrame, email: str = "sender_email", domain: str = "sender_domain",
                broadcast: bool = False) -> DataFrame:
    """Add whitelist_reason and blacklist_reason, NULL where the sender is on neither list.

    The list is folded to one row per item, so two equi-joins (address, domain) serve both lists. They
    carry no hint: a list under the broadcast threshold is broadcast, a larger one is joined by key with
    skewed senders split at run time. ``broadcast`` is for callers that have checked the size of the list.
    """
    folded = current.groupBy("item_type", "item").agg(
        F.max(F.when(F.col("list_type") == "whitelist", True)).alias("wl"),
        F.max(F.when(F.col("list_type") == "blacklist", True)).alias("bl"))
    by_email = folded.filter(F.col("item_type") == "email").select(
        F.col("item").alias("_le"), F.col("wl").alias("_ewl"), F.col("bl").alias("_ebl"))
    by_domain = folded.filter(F.col("item_type") == "domain").select(
        F.col("item").alias("_ld"), F.col("wl").alias("_dwl"), F.col("bl").alias("_dbl"))
    if broadcast:
        by_email, by_domain = F.broadcast(by_email), F.broadcast(by_domain)
    keyed = messages.withColumns({
        "_ke": F.lower(tx.or_empty(F.col(email))),
        "_kd": ad.lookup_domain(F.col(email), F.col(domain)),
    })
    joined = keyed.join(by_email, F.col("_ke") == F.col("_le"), "left").join(
        by_domain, F.col("_kd") == F.col("_ld"), "left")

    def reason(on_email: str, on_domain: str, word: str) -> Column:
        return F.when(F.col(on_email), F.concat(F.lit("Email '"), F.col("_ke"), F.lit(f"' is {word}"))).when(
            F.col(on_domain), F.concat(F.lit("Domain '"), F.col("_kd"), F.lit(f"' is {word}")))

    return joined.withColumns({
        "whitelist_reason": reason("_ewl", "_dwl", "whitelisted"),
        "blacklist_reason": reason("_ebl", "_dbl", "blacklisted"),
    }).drop("_ke", "_kd", "_le", "_ld", "_ewl", "_ebl", "_dwl", "_dbl")


def match_whitelist(messages: DataFrame, current: DataFrame) -> DataFrame:
    only = current.filter(F.col("list_type") == "whitelist")
    return match_lists(messages, only).drop("blacklist_reason").filter(F.col("whitelist_reason").isNotNull())


def match_blacklist(messages: DataFrame, current: DataFrame) -> DataFrame:
    only = current.filter(F.col("list_type") == "blacklist")
    return match_lists(messages, only).drop("whitelist_reason").filter(F.col("blacklist_reason").isNotNull())


def not_already_listed(senders: DataFrame, current: DataFrame, list_type: str) -> DataFrame:
    """Rows whose sender is on the list by neither address nor domain."""
    return not_on_same_list(senders.withColumn("list_type", F.lit(list_type)), current).drop("list_type")


def not_on_same_list(senders: DataFrame, current: DataFrame) -> DataFrame:
    """``not_already_listed`` with the list named per row in list_type."""
    known = current.select(F.col("list_type").alias("_lt"), F.col("item_type").alias("_lk"), F.col("item").alias("_li"))
    email = F.lower(tx.or_empty(F.col("sender_email")))
    domain = ad.lookup_domain(F.col("sender_email"), F.col("sender_domain"))
    out = senders
    for kind, key in (("email", email), ("domain", domain)):
        side = known.filter(F.col("_lk") == kind)
        out = out.join(side, (F.col("list_type") == F.col("_lt")) & (key == F.col("_li")), "left_anti")
    return out
