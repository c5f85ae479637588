"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; the runner writes it and rereads it as the next stage's
docs. All but the last give the columns of documents. Rows without doc_id pass the first three stages if their text is
good: without an id they belong to no group of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import near, quality, toxicity
from mailsieve.llm.queries import may_learn, packed, small_batches, table
from mailsieve.plans.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    small_batches(spark)
    return quality.keep_good(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not predicted to be toxic. Their own columns stay as they are, whatever their names."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), may_learn())
    names = {n: next(m for m in (f"_{n}{'_' * i}" for i in range(len(docs.columns) + 1)) if m not in docs.columns) for n in ("score", "toxic")}
    judged = toxicity.score(docs, model, output=names["score"], predicted=names["toxic"])
    return judged.where(F.col(names["toxic"]) == 0).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row: that with the least doc_id. Where rows share a doc_id and not the
    class, each is judged by its own text."""
    small_batches(spark)
    classes = materialize(near.near_classes(docs, with_node=True).where("doc_id IS NOT NULL"), "classes")
    first = classes.where("doc_id = class_id").select("doc_id", F.col("node").alias("_node")).distinct()
    shared = classes.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("doc_id")
    plain = docs.join(first.select("doc_id").distinct().join(shared, "doc_id", "left_anti"), "doc_id", "left_semi")
    rows = docs.join(shared, "doc_id", "left_semi").select(
        F.struct(*docs.columns).alias("row"), "doc_id", near.node_of(F.col("text")).alias("node"))
    judged = rows.join(first, (rows["doc_id"] == first["doc_id"]) & rows["node"].eqNullSafe(first["_node"]), "left_semi")
    named = plain.unionByName(judged.select("row.*")).dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    small_batches(spark)
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("packing", packing),
]

#: SQL cannot express robust estimates, Viterbi decoding or token ids; tests compare each stage with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
