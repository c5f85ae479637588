"""Stored state: lists, verdict cache, sender history, training samples, logs, models.

Append-only facts are parquet folders that grow. Every write is a version folder that counts once it is committed, so a
lost job never leaves a half-written table in use. Keyed state is stored as change rows: a version holds the rows that
one round has changed, readers fold them to the latest row of each key, and ``compact`` folds them for good and deletes
what is no longer needed.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions import addresses as ad
from mailsieve.functions import fixed_values as fv
from mailsieve.functions import text as tx
from mailsieve.operators import lists, training, verdicts

_LIST_JSON = "emails array<string>, domains array<string>"
_LIST_ROW = "item_type string, item string"
_SAMPLE_JSON = (
    "email_data struct<sender_email:string,sender_domain:string,subject:string,body:string,text_content:string>, "
    "is_spam boolean, source string, _corrupt_record string")


# sender lists

def read_list_json(spark: SparkSession, path: str, list_type: str) -> DataFrame:
    """List rows of an export: {item_type, item} rows, or one {emails, domains} document; a broken one is an empty list."""
    docs = spark.read.schema(_LIST_JSON).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    rows = spark.read.schema(_LIST_ROW).option("mode", "PERMISSIVE").json(path)

    def side(name: str, kind: str) -> DataFrame:
        return docs.select(F.lit(list_type).alias("list_type"), F.lit(kind).alias("item_type"), F.explode(name).alias("item"))

    own = rows.where("item IS NOT NULL AND item_type IN ('email', 'domain')").select(F.lit(list_type).alias("list_type"), "item_type", "item")
    return own.unionByName(side("emails", "email")).unionByName(side("domains", "domain")).distinct()


def read_list_text(spark: SparkSession, path: str) -> DataFrame:
    """One raw item per line."""
    return list_lines(spark.read.text(path))


def list_lines(lines: DataFrame) -> DataFrame:
    """(value) -> raw_item and its type; blank lines dropped."""
    item = tx.strip(F.col("value"))
    return lines.select(item.alias("raw_item")).filter(F.col("raw_item") != "").withColumn(
        "item_type", ad.item_type(F.col("raw_item")))


def list_rows_json(current: DataFrame, list_type: str) -> DataFrame:
    """Sorted items as one JSON object per row: the export form for lists of any size."""
    return lists.list_contents(current, list_type).select(F.to_json(F.struct("item_type", "item")).alias("value"))


def export_list(current: DataFrame, list_type: str, path: str, one_document: bool = False) -> None:
    """A folder of sorted JSON rows, whatever the size. ``one_document`` gives one {emails, domains} document
    instead, made in one task: for lists that the caller knows to be short."""
    if not one_document:
        list_rows_json(current, list_type).write.text(path)
        return

    def items(kind: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("item_type") == kind, F.col("item"))))

    chosen = current.filter(F.col("list_type") == list_type)
    chosen.agg(items("email").alias("emails"), items("domain").alias("domains")).coalesce(1).write.json(path)


# versioned keyed tables: data/version=N folders, and a commits folder naming the finished ones

def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/data/version={version:010d}"


def write_version(frame: DataFrame, root: str, version: int) -> None:
    """Write one version and then commit it. Writing it again replaces it."""
    frame.write.mode("overwrite").parquet(version_path(root, version))
    frame.sparkSession.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").json(
        f"{root.rstrip('/')}/commits")


def read_latest(spark: SparkSession, root: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """A given version, or the newest committed one; an empty table when there is none. Of a table of change rows
    (``write_changes``) the state as of that version: the latest row of each key."""
    keys = table_keys(spark, root)
    if keys is not None:
        return read_state(spark, root, schema, version)
    if version is None:
        version = latest_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(version_path(root, version))


def latest_version(spark: SparkSession, root: str) -> int | None:
    try:
        commits = spark.read.schema("version bigint").json(f"{root.rstrip('/')}/commits")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return commits.agg(F.max("version")).first()[0]


def read_committed(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all committed versions; folders that a lost job has left behind are not read."""
    try:
        commits = spark.read.schema("version bigint").json(f"{root.rstrip('/')}/commits").distinct()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version bigint")
    rows = spark.read.parquet(f"{root.rstrip('/')}/data")
    return rows.withColumn("version", F.col("version").cast("bigint")).join(commits, "version", "left_semi")


def _commits(spark: SparkSession, root: str) -> list[int]:
    """The committed versions: one small number for each batch that was written."""
    if latest_version(spark, root) is None:
        return []
    return sorted(r[0] for r in spark.read.schema("version bigint").json(f"{root.rstrip('/')}/commits").distinct().collect())


# keyed state as change rows: data/version=N holds what round N changed, snapshots/version=N the whole state as of N

_KEYS = "keys.json"


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, whatever store it is on, and the path for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def snapshot_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/snapshots/version={version:010d}"


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Versions of the finished snapshots; one whose job was lost has no success mark."""
    files, at = _file_system(spark, f"{root.rstrip('/')}/snapshots")
    if not files.exists(at):
        return []
    found = [int(s.getPath().getName().removeprefix("version=")) for s in files.listStatus(at)]
    return sorted(v for v in found if files.exists(_file_system(spark, f"{snapshot_path(root, v)}/_SUCCESS")[1]))


def table_keys(spark: SparkSession, root: str) -> list[str] | None:
    """The key columns of a table of change rows, None for other tables."""
    files, at = _file_system(spark, f"{root.rstrip('/')}/{_KEYS}")
    if not files.exists(at):
        return None
    return json.loads(spark.read.text(at.toString()).first()[0])


def write_changes(changes: DataFrame, root: str, version: int, keys: list[str]) -> None:
    """Append the rows that a round has changed, at most one for each key, and commit them. What is written follows the
    round, not the state. A row with ``_deleted`` true takes its key away. Writing a version again replaces it, and
    snapshots that hold its first writing go."""
    spark, root = changes.sparkSession, root.rstrip("/")
    if table_keys(spark, root) is None:
        files, at = _file_system(spark, f"{root}/{_KEYS}")
        out = files.create(at, True)
        out.write(bytearray(json.dumps(keys).encode()))
        out.close()
    for stale in [v for v in snapshots(spark, root) if v >= version]:
        _remove(spark, snapshot_path(root, stale))
    if "_deleted" not in changes.columns:
        changes = changes.withColumn("_deleted", F.lit(False))
    write_version(changes, root, version)


def read_state(spark: SparkSession, root: str, schema: str | None = None, version: int | None = None,
               only: DataFrame | None = None) -> DataFrame:
    """The latest row of each key as of a version, from the newest snapshot up to it and the changes since; with
    ``only`` (key columns, few rows) just these keys, which are picked before anything is grouped."""
    keys = table_keys(spark, root) or []
    known = [v for v in _commits(spark, root) if version is None or v <= version]
    if not known:
        return spark.createDataFrame([], schema)
    folded = max((v for v in snapshots(spark, root) if v <= known[-1]), default=None)
    since = [v for v in known if folded is None or v > folded]
    for v in since:
        files, at = _file_system(spark, version_path(root, v))
        if not files.exists(at):
            raise LookupError(f"version {v} of {root} is older than what compaction has kept")
    parts = [(spark.read.parquet(version_path(root, v)), v) for v in since]
    if folded is not None:
        parts.append((spark.read.parquet(snapshot_path(root, folded)), folded))
    rows = None
    for frame, v in parts:
        frame = frame.withColumn("_version", F.lit(v).cast("bigint"))
        rows = frame if rows is None else rows.unionByName(frame, allowMissingColumns=True)
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), keys, "left_semi")
    state = verdicts.pick_row(rows, keys, F.col("_version"), latest=True)
    names = [c for c in rows.columns if c not in ("_version", "_deleted")]
    return state.where("NOT coalesce(_deleted, false)").select(*names)


def compact(spark: SparkSession, root: str, every: int = 10, keep: int = 2) -> bool:
    """Write the state as a snapshot when ``every`` versions have come since the last one, keep the newest ``keep``
    snapshots and what came after the oldest of them, and delete what is older. Round numbers from that oldest one on
    can still be read, so a round that is repeated finds the state it started from."""
    known, done = _commits(spark, root), snapshots(spark, root)
    if not known or len([v for v in known if not done or v > done[-1]]) < every:
        return False
    read_state(spark, root, version=known[-1]).withColumn("_deleted", F.lit(False)).write.mode("overwrite").parquet(
        snapshot_path(root, known[-1]))
    kept = snapshots(spark, root)[-keep:]
    if len(kept) == keep:
        for old in [v for v in snapshots(spark, root) if v < kept[0]]:
            _remove(spark, snapshot_path(root, old))
        for old in [v for v in known if v <= kept[0]]:
            _remove(spark, version_path(root, old))
    return True


CACHE_SCHEMA = (
    "fingerprint string, action string, reason string, confidence double, method string, override boolean, cached_at timestamp_ntz")


def read_verdict_cache(spark: SparkSession, root: str, max_age_days: int, as_of: Column) -> DataFrame:
    return verdicts.live_cache(read_latest(spark, root, CACHE_SCHEMA), max_age_days, as_of)


def write_verdict_cache(spark: SparkSession, root: str, newer: DataFrame, version: int) -> None:
    """The newer verdicts as change rows, one for each fingerprint."""
    write_changes(verdicts.merge_cache(spark.createDataFrame([], CACHE_SCHEMA), newer), root, version, ["fingerprint"])


# training samples

def append_training_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("append").json(path)


def read_training_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines -> samples; broken or incomplete records are left out."""
    lines = spark.read.text(path)
    return parse_training_samples(lines.withColumn("sample_id", F.sha2("value", 256)))


def parse_training_samples(lines: DataFrame) -> DataFrame:
    """(sample_id, value) -> valid samples: those with an email_data object and an is_spam flag."""
    record = F.from_json("value", _SAMPLE_JSON, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_r", record).filter(
        F.col("_r._corrupt_record").isNull() & F.col("_r.email_data").isNotNull() & F.col("_r.is_spam").isNotNull())
    mail = F.col("_r.email_data")
    return rows.select(
        "sample_id", mail["sender_email"].alias("sender_email"), mail["sender_domain"].alias("sender_domain"),
        mail["subject"].alias("subject"), F.coalesce(mail["body"], mail["text_content"], F.lit("")).alias("body"),
        F.col("_r.is_spam").alias("is_spam"), F.col("_r.source").alias("source"))


def samples_to_json(samples: DataFrame) -> DataFrame:
    mail = F.struct("sender_email", "sender_domain", "subject", "body")
    return samples.select(F.to_json(F.struct(mail.alias("email_data"), "is_spam", "source")).alias("value"))


# logs and reports

def write_decision_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("action").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.text(path)


# models

def save_model(model: PipelineModel, path: str, spark: SparkSession) -> None:
    """The fitted pipeline with the feature names it was trained on."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(list(fv.FEATURE_NAMES)),)], "names string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/features")


def saved_feature_names(spark: SparkSession, path: str) -> list[str]:
    return json.loads(spark.read.schema("names string").json(f"{path}/features").first()[0])


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """The saved model, or a cold-start model when its features are not today's."""
    if saved_feature_names(spark, path) != list(fv.FEATURE_NAMES):
        samples = training.default_training_samples(spark)
        return training.train_forest(training.weighted_features(samples)).model
    return PipelineModel.load(f"{path}/model")
