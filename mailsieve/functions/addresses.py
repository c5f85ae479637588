"""Sender fields and list items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions import text as tx

# Local part, '@', dotted host name whose labels neither start nor end with '-'. Every repetition is possessive and no
# group captures, so an address of any length is matched in a loop, without recursion.
_LOCAL_CHARS = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
ADDRESS_SYNTAX = (
    rf"^{_LOCAL_CHARS}++(?:\.{_LOCAL_CHARS}++)*+"
    r"@(?:[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+\.)++[A-Za-z]{2,}+$"
)


def extract_address(sender: Column) -> Column:
    """The part in angle brackets, else the trimmed field if it has an '@', else ''."""
    bracketed = F.regexp_extract(sender, r"<([^\n]+?)>", 1)
    return (
        F.when(bracketed != "", bracketed)
        .when(F.contains(sender, F.lit("@")), tx.strip(sender))
        .otherwise("")
    )


def sender_domain(address: Column) -> Column:
    """Text after the last '@', '' without one. Case is kept."""
    return F.when(F.contains(address, F.lit("@")), F.substring_index(address, "@", -1)).otherwise("")


def lookup_domain(address: Column, domain: Column) -> Column:
    """Domain used for list lookups: the given one, else the end of the address, else the address itself."""
    return F.lower(F.when(tx.or_empty(domain) != "", domain).otherwise(
        F.substring_index(tx.or_empty(address), "@", -1)))


def item_type(item: Column) -> Column:
    return F.when(F.contains(item, F.lit("@")), "email").otherwise("domain")


def normalize_email(item: Column) -> Column:
    """Lowercase address, NULL when the syntax is wrong. Name servers are not asked."""
    trimmed = tx.strip(item)
    return F.when(F.rlike(trimmed, F.lit(ADDRESS_SYNTAX)), F.lower(trimmed))


def normalize_domain(item: Column) -> Column:
    """Lowercase host without scheme and path, NULL without a dot."""
    host = F.regexp_replace(F.lower(tx.strip(item)), "^https?://", "")
    host = F.substring_index(host, "/", 1)
    return F.when(F.contains(host, F.lit(".")), host)


def normalize_item(item: Column, kind: Column) -> Column:
    """Canonical form by kind, NULL when invalid or of an unknown kind."""
    return tx.let(
        F.struct(item.alias("item"), kind.alias("kind")),
        lambda t: F.when(t["kind"] == "email", normalize_email(t["item"])).when(
            t["kind"] == "domain", normalize_domain(t["item"])))
