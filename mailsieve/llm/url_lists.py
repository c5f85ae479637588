"""Temporal URL lists: every capture is judged by the list entries that were active when it was fetched.

Dated entries (a list adds or removes a pattern) become validity intervals, and an as-of join finds, for each capture,
the patterns whose interval holds its day. Patterns are hosts, which also match their subdomains, and host/path
prefixes at segment borders. All of it is DataFrame operations.

The join is by pattern and by a bucket of ``bucket_days`` days: an interval stands in every bucket that it overlaps
within the captured time, so captures of a host with a third of all rows are spread over the buckets, and what is left
of skew is a plain join that adaptive execution splits. Equal captures (same URL, same day) are judged once. Nothing
is broadcast by hand.

An allow list overrides block lists. On one day a removal counts after an addition. Equal entries count once; entries
without list, pattern, day or action are left out. Captures without URL, without a host in it or without a day match
nothing and get the verdict 'none'. Repeated captures all stay. Only as many host labels and path segments are tried
as the longest pattern has, so very long URLs cost no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lowercase host without user, port and closing dot; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """list_id, verdict, pattern, valid_from, valid_to (exclusive) for entries(list_id, verdict, pattern, action,
    dated). Days of one pattern are aggregated first, so a window holds at most one row a day."""
    whole = entries.where("list_id IS NOT NULL AND verdict IS NOT NULL AND pattern <> '' AND dated IS NOT NULL AND action IN ('add', 'remove')")
    days = whole.groupBy("list_id", "verdict", "pattern", F.col("dated").cast("date").alias("valid_from")).agg(F.max("action").alias("action"))
    later = Window.partitionBy("list_id", "verdict", "pattern").orderBy("valid_from")
    return (
        days.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(later), F.to_date(F.lit(FOREVER))))
        .where("action = 'add'").drop("action"))


def _bucket(day: Column, bucket_days: int) -> Column:
    return F.floor(F.datediff(day, F.to_date(F.lit("1970-01-01"))) / bucket_days).cast("int")


def _probes(url: Column, host: Column, labels: int, segments: int) -> Column:
    """The patterns that could match: the last 1.. labels of the host, and the host with the first 1.. segments."""
    parts = F.split(host, r"\.")
    size = F.size(parts)
    hosts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(size, F.lit(labels)))),
        lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), size - n + 1), n), "."))
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "^/", "")
    steps = F.filter(F.split(path, "/", segments + 1), lambda s: s != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(steps), F.lit(segments)))),
        lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")))
    return F.array_distinct(F.concat(hosts, F.when((F.size(steps) > 0) & (F.lit(segments) > 0), prefixes).otherwise(F.array().cast("array<string>"))))


def judge(captures: DataFrame, entries: DataFrame, bucket_days: int = 32) -> DataFrame:
    """The captures (with columns url and fetched_on) with host, verdict (allow, block or none), how many lists
    matched and their names in order."""
    spans = intervals(entries)
    depth = F.size(F.split("pattern", "/")) - 1
    sizes = spans.agg(F.max(F.size(F.split(F.split_part("pattern", F.lit("/"), F.lit(1)), r"\."))).alias("labels"), F.max(depth).alias("segments"))
    known = captures.where("url IS NOT NULL AND fetched_on IS NOT NULL")
    seen = known.agg(F.min(F.col("fetched_on").cast("date")).alias("first"), F.max(F.col("fetched_on").cast("date")).alias("last"))
    (size,), (time,) = sizes.collect(), seen.collect()  # one row each
    kept = captures.drop("host", "verdict", "n_lists", "lists")
    host = host_of(F.col("url"))
    if size["labels"] is None or time["first"] is None:
        return kept.withColumns({"host": F.coalesce(host, F.lit("")), "verdict": F.lit("none"), "n_lists": F.lit(0), "lists": F.lit("")})
    first, last = F.lit(time["first"]), F.lit(time["last"])
    spread = (
        spans.where((F.col("valid_from") <= last) & (F.col("valid_to") > first))
        .withColumn("bucket", F.explode(F.sequence(
            _bucket(F.greatest("valid_from", first), bucket_days), _bucket(F.least("valid_to", last), bucket_days)))))
    asked = known.select("url", F.col("fetched_on").cast("date").alias("_day")).distinct()
    probed = asked.select(
        "url", "_day", _bucket(F.col("_day"), bucket_days).alias("bucket"),
        F.explode(_probes(F.col("url"), host, size["labels"], size["segments"])).alias("pattern")).where("pattern <> ''")
    active = probed.join(spread, ["pattern", "bucket"]).where("_day >= valid_from AND _day < valid_to")
    found = active.groupBy("url", "_day").agg(
        F.min("verdict").alias("_verdict"), F.sort_array(F.collect_set("list_id")).alias("_names"))
    return (
        kept.withColumn("_day", F.col("fetched_on").cast("date")).join(found, ["url", "_day"], "left")
        .select(*kept.columns, F.coalesce(host, F.lit("")).alias("host"), F.coalesce("_verdict", F.lit("none")).alias("verdict"),
                F.coalesce(F.size("_names"), F.lit(0)).alias("n_lists"), F.coalesce(F.array_join("_names", ","), F.lit("")).alias("lists")))
