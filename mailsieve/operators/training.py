"""Training sets, weights, split, forest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsieve.config import EngineConfig
from mailsieve.functions import features as ft
from mailsieve.functions import fixed_values as fv
from mailsieve.functions import identity
from mailsieve.functions import text as tx
from mailsieve.operators import verdicts
from mailsieve.plans.session import small_splits
from mailsieve.plans.skew import running_position

SAMPLE_COLUMNS = ("sample_id", "sender_email", "sender_domain", "subject", "body", "is_spam", "source")

# Cold-start samples: (sender, subject, body, is_spam).
_COLD_START = (
    ("anna@ridgewalkers.org", "Car sharing for Sunday's ridge walk",
     "I can take three people from the station at seven. Bring rain clothes and something to eat. Who else drives?", False),
    ("airdrop@coin-vault.top", "Double your coins tonight, only 40 wallets left!!!",
     "Send any amount to the vault and get TWICE as much back. Click here: http://coin-vault.top/claim Act now, this is free money!", True),
    ("reception@molar-practice.com", "Your check-up in the second week of June",
     "This is a reminder of your appointment with us. If the time does not suit you, please ring the practice.", False),
    ("depot@customs-release.click", "Package held, fee of $1.99 unpaid",
     "We could not hand over your package. Pay the fee within 12 hours or it will be destroyed: http://customs-release.click/pay", True),
    ("meter@citypower.net", "Reading of the electricity meter",
     "Please send us the number on your meter by the end of the month. You find it above the bar code.", False),
    ("luxury@timepiece-copies.tk", "Swiss watches, same look, 90% off",
     "Nobody can tell the difference! Cheap prices, free shipping, order now while the offer lasts. http://timepiece-copies.tk", True),
    ("tenor@harbourchoir.org", "Rehearsal room changed",
     "We sing in the small hall this week because the floor of the large one is being repaired. Scores are on the piano.", False),
    ("growth@fans-and-likes.ml", "10,000 real followers for your page!!!",
     "Be famous by tomorrow! Buy followers and likes, guaranteed, limited offer. Subscribe today: http://fans-and-likes.ml/buy", True),
    ("oskar@kitchentable.net", "That lentil soup",
     "You asked for the recipe: two onions, a cup of red lentils, cumin, half a lemon at the very end. It keeps for days.", False),
    ("approval@instant-loan.ga", "Loan approved without any check",
     "Congratulations! You have been selected for a cash loan. No questions asked. Confirm your account number urgently here.", True),
)


def default_training_samples(spark: SparkSession) -> DataFrame:
    """Ten built-in samples, five of each class."""
    rows = [(f"default-{i}", s, s.split("@")[-1], t, b, spam, "default") for i, (s, t, b, spam) in enumerate(_COLD_START)]
    return spark.createDataFrame(
        rows, "sample_id string, sender_email string, sender_domain string, subject string, body string, is_spam boolean, source string")


def sample_weight() -> Column:
    """5 for senders with a settled pattern, half as much again for known ones, 3 for user feedback, else 1."""
    base = F.when(F.col("source") == "user_feedback", 3.0).otherwise(1.0)
    total = F.col("sender_total_feedbacks")
    settled = (F.col("sender_is_recurring_spammer") == 1.0) | (F.col("sender_is_recurring_ham") == 1.0) | (total >= 3)
    return F.when(settled, 5.0).when(total >= 2, base * 1.5).otherwise(base)


def stratified_split(samples: DataFrame, row_id: str = "sample_id", config: EngineConfig = EngineConfig(),
                     min_rows: int = 20) -> DataFrame:
    """Add ``part`` (train, test, or both): an exact share of each class by a stable random order.

    Position inside a class is found over 4,096 key ranges, so neither class is sorted in one task.
    Under ``min_rows`` samples train and test are the same.
    """
    keyed = samples.withColumn("_key", identity.split_key(F.col(row_id), config.seed))
    placed = running_position(keyed, ["is_spam"], F.substring("_key", 1, 3), [F.col("_key"), F.col(row_id)], F.col("_bucket"))
    sizes = samples.groupBy("is_spam").agg(F.count("*").alias("_class"))
    sizes = sizes.withColumn("_all", F.sum("_class").over(Window.partitionBy(F.lit(1))))  # one row per class
    part = (
        F.when(F.col("_all") < min_rows, "both")
        .when(F.col("position") <= F.round(F.col("_class") * F.lit(config.test_share)), "test")
        .otherwise("train"))
    return placed.join(sizes, "is_spam").withColumn("part", part).drop("_key", "_class", "_all", "position")


def class_balance(train: DataFrame) -> DataFrame:
    """is_spam -> balance weight n / (2 * n_class); at most two rows."""
    sizes = train.groupBy("is_spam").agg(F.count("*").alias("class_rows"))
    total = F.sum("class_rows").over(Window.partitionBy(F.lit(1)))
    return sizes.withColumn("balance", total / (F.lit(2.0) * F.col("class_rows")))


def training_report(weighted: DataFrame) -> DataFrame:
    return weighted.agg(
        F.count("*").alias("samples"), F.count_if("is_spam").alias("spam"), F.count_if(~F.col("is_spam")).alias("ham"),
        F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"),
        F.avg("weight").alias("weight_mean"), F.sum("weight").alias("weight_total"))


def override_samples(cache: DataFrame) -> DataFrame:
    """Overrides know only the decision, so each becomes a synthetic sample."""
    chosen = cache.filter((F.col("method") == "user_feedback") & F.coalesce(F.col("override"), F.lit(False)))
    head, spam = F.substring("fingerprint", 1, 8), F.col("action") == "SPAM"
    return chosen.select(
        F.concat(F.lit("override-"), F.col("fingerprint")).alias("sample_id"),
        F.concat(F.lit("user_feedback_"), head, F.lit("@example.com")).alias("sender_email"),
        F.lit("user-feedback.local").alias("sender_domain"),
        F.concat(F.lit("User feedback sample "), head).alias("subject"),
        F.concat(F.lit("User feedback training sample for "), F.when(spam, "spam").otherwise("ham"), F.lit(" classification")).alias("body"),
        spam.alias("is_spam"), F.lit("user_feedback").alias("source"))


def dedup_training(samples: DataFrame) -> DataFrame:
    """First sample per sender + subject + start of the text, in order of (source_rank, sample_id); of fully
    equal ones one stays.

    The keys are compared first and the full rows joined after, so bodies are not carried through the
    aggregation. What is joined then shares key, rank and id at most, so few rows reach the last step.
    """
    keyed = samples.withColumn("_key", identity.training_key(F.col("sender_email"), F.col("subject"), F.col("body")))
    first = keyed.groupBy("_key").agg(F.min(F.struct("source_rank", "sample_id")).alias("_first"))
    first = first.select("_key", F.col("_first.source_rank").alias("source_rank"), F.col("_first.sample_id").alias("sample_id"))
    return keyed.join(first, ["_key", "source_rank", "sample_id"], "left_semi").dropDuplicates(["_key"]).drop("_key")


def assemble_training_set(cache: DataFrame, stored: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Overrides, then stored samples, then (only when there are fewer than ten) the built-in ones; deduplicated."""
    spark = stored.sparkSession
    collected = override_samples(cache).select(*SAMPLE_COLUMNS, F.lit(0).alias("source_rank")).unionByName(
        stored.select(*SAMPLE_COLUMNS, F.lit(1).alias("source_rank")))
    if collected.limit(config.min_training_samples).count() < config.min_training_samples:
        collected = collected.unionByName(
            default_training_samples(spark).select(*SAMPLE_COLUMNS, F.lit(2).alias("source_rank")))
    return dedup_training(collected)


def collect_scorer_samples(decisions: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Confident scorer verdicts, one per fingerprint, as (fingerprint, msg_id, is_spam)."""
    sure = decisions.filter(F.startswith("method", F.lit("llm_")) & (F.col("confidence") >= config.collect_min_confidence))
    return sure.groupBy("fingerprint").agg(
        F.min("msg_id").alias("msg_id"), F.min_by(F.col("action") == "SPAM", "msg_id").alias("is_spam"))


def retrain_due(pending: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Pending samples per pool and whether the pool triggers a retrain."""
    return pending.groupBy("pool").agg(F.count("*").alias("pending")).withColumn(
        "due", F.col("pending") >= config.retrain_threshold)


def weighted_features(samples: DataFrame, history: DataFrame | None = None, *, as_of: Column | None = None,
                      config: EngineConfig = EngineConfig()) -> DataFrame:
    """Samples -> features, label and weight."""
    if "raw_headers" not in samples.columns:
        samples = samples.withColumn("raw_headers", F.lit(None).cast("map<string,array<string>>"))
    if "received_at" not in samples.columns:
        samples = samples.withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    frame = ft.extract_features(
        samples, history, as_of=as_of, keep=("sample_id", "is_spam", "source"),
        lexicons=config.lexicons, compat_zero_days=config.compat_zero_days)
    return frame.withColumn("weight", sample_weight())


@dataclass
class TrainingResult:
    success: bool
    model: PipelineModel | None = None
    accuracy: float | None = None
    report: dict | None = None
    error: str | None = None


def forest_pipeline(config: EngineConfig) -> Pipeline:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    forest = RandomForestClassifier(
        featuresCol="scaled", labelCol="label", weightCol="train_weight", numTrees=config.num_trees,
        maxDepth=config.max_depth, seed=config.seed)
    return Pipeline(stages=[scaler, forest])


def train_forest(weighted: DataFrame, config: EngineConfig = EngineConfig()) -> TrainingResult:
    """Fit on the training part, measure accuracy on the test part. Needs ``weighted_features`` rows."""
    if weighted.limit(config.min_training_samples).count() < config.min_training_samples:
        return TrainingResult(False, error=f"Need at least {config.min_training_samples} samples for training")
    vectors = ft.to_vector(weighted).select(
        "sample_id", "is_spam", "weight", F.col("is_spam").cast("double").alias("label"), "features")
    parts = stratified_split(vectors, config=config).persist()
    try:
        with small_splits(weighted.sparkSession):
            report = training_report(parts).first().asDict()  # reads all rows, so the features are kept from here on
        train = parts.filter(F.col("part").isin("train", "both"))
        train = train.join(F.broadcast(class_balance(train)), "is_spam").withColumn(  # two rows at most
            "train_weight", F.col("weight") * F.col("balance"))
        model = forest_pipeline(config).fit(train)
        scored = model.transform(parts.filter(F.col("part").isin("test", "both")))
        accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)
    finally:
        parts.unpersist()
    return TrainingResult(True, model, accuracy, report)


def forest_score(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Add ``p_spam``; NULL without a model. Reading it off the probability vector covers one-class models."""
    if model is None:
        return features.withColumn("p_spam", F.lit(None).cast("double"))
    scored = model.transform(ft.to_vector(features))
    probability = vector_to_array("probability")
    p_spam = F.when(F.size(probability) > 1, F.get(probability, F.lit(1))).otherwise(F.lit(0.0))
    return scored.withColumn("p_spam", p_spam).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance), most important first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(fv.FEATURE_NAMES, values)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
