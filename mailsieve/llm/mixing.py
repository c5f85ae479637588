"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share, by weight, of all words; it stops at ``most`` times the words that the source has, and
what it cannot take is shared again among the others. With sources in the order of cap / weight, those below the water
level are a prefix, so running sums of caps and weights give the level at once.

Every document is due target / source_size copies. The whole ones are certain. The fraction is its inclusion
probability for one more: documents are ranked by random odds divided by inclusion odds, and the first ones are taken
while they fit into the words that the source still lacks. Sample sizes are counted in words, the targets' unit. One
document more, the one that comes nearest to what is then missing, closes the gap where that makes it smaller.

The random number of a document is a digest of its id and text, so reruns agree. Rows with equal id and text have equal
numbers and sizes, and which of them is taken makes no difference to the result.

A missing text has no words, an empty or missing one takes no words. A missing source is a source of its own, the last.
Rows without doc_id and rows that share one are documents like others. Texts of any length are counted whole. A table
without words has targets of 0; an empty one gives no rows. Columns other than doc_id, source and text are not looked at.

Documents are ranked by ranges of the order (see ``positions``), and sources meet their documents by a salted key, so a
source with most rows is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.positions import beside, running
from mailsieve.plans.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16


@dataclass(frozen=True)
class MixRules:
    #: weights of the sources by code point, repeating
    weights: tuple[int, ...] = (5, 2, 1)
    #: copies of a document at most
    most: int = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_number(doc_id: Column, text: Column) -> Column:
    """Above 0 and below 1, from the first 52 bits of a digest."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """sources(source, source_size) with the target of each, its certain ``copies``, and the words ``lacking`` after them."""
    place = [F.col("source").isNull(), F.col("source")]
    named = running(sources, [], place, [], "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in rules.weights]), (F.col("position") % len(rules.weights) + 1).cast("int"))
    weighed = named.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * rules.most).alias("cap"))
    weighed = weighed.withColumn("limit", F.col("cap") / F.col("weight"))
    filled = running(weighed, [], [F.col("limit"), *place], ["cap", "weight"], "levels")
    total = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    filled = filled.crossJoin(total).withColumn(
        "level", (F.col("words") - F.col("before_cap")).cast("double") / (F.col("weights") - F.col("before_weight")).cast("double"))
    filled = materialize(filled.withColumn("full", F.col("limit") < F.col("level")), "levels")
    level = filled.agg(F.max(F.when(~F.col("full"), F.col("level"))).alias("water"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    lacking = F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))
    return filled.crossJoin(level).withColumn("target", target).withColumn("copies", copies).withColumn("lacking", lacking).select(
        "source", "source_size", "target", "copies", "lacking")


def _beside_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows``, which have a row number ``tie``, with the columns of their source."""
    copied = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("tie"), F.lit(SALTS)).cast("int"))
    return beside(rows, copied, ["source", "salt"], "left").drop("salt")


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies), one row for each row of ``docs``."""
    text = F.col("text").cast("string")
    narrow = docs.select("doc_id", "source", word_count(text).alias("size"), random_number(F.col("doc_id"), text).alias("u"))
    narrow = materialize(narrow.withColumn("tie", F.monotonically_increasing_id()), "sizes")
    sources = materialize(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), rules), "targets")

    chance = F.col("lacking") / F.col("source_size")
    rank = F.when(F.col("lacking") > 0, _odds(F.col("u")) / _odds(chance)).otherwise(_odds(F.col("u")))
    due = _beside_source(narrow, sources).withColumn("rank", rank)
    ranked = running(due, ["source"], [F.col("rank"), F.col("tie")], ["size"], "order")
    ranked = materialize(ranked.withColumn("fits", F.col("before_size") + F.col("size") <= F.col("lacking")), "ranked")

    got = ranked.groupBy("source").agg((F.max("lacking") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap"))
    rest = _beside_source(ranked.where("NOT fits"), materialize(got, "gaps")).withColumn("miss", F.abs(F.col("gap") - F.col("size")))
    last = rest.where("miss < gap").groupBy("source").agg(F.min(F.struct("miss", "rank", "tie"))["tie"].alias("last"))
    chosen = F.col("fits") | F.coalesce(F.col("tie") == F.col("last"), F.lit(False))
    found = _beside_source(ranked, materialize(last, "last")).withColumn("copies", F.col("copies") + chosen.cast("long"))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
