"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

``text_statistics`` measures every whole text. ``with_verdict`` estimates, for each language and source, the centre and
the scatter of the transformed statistics by the minimum covariance determinant. Three starts (medians and quartiles,
all rows, rows drawn to the unit ellipsoid about the medians) are each followed by concentration steps: the closest
three quarters of the rows are kept, centre and scatter are estimated from them and all rows are measured anew, until
the determinant stops falling. The estimate of least determinant counts. Each step lowers the logarithm of the
determinant by ``tolerance`` or is the last, and ``floors`` bound it from below, so the steps end. Rows whose Mahalanobis
distance exceeds the limit are rejected.

All sums and quantiles are aggregates over the narrow table of statistics with combining before the shuffle, so a
source with a third of all rows reaches an exchange as one row a task. Only one row for each language and source is
ever turned into a matrix, and these rows stay distributed.

Whole texts are measured, however long, a few rows at a time. Missing text: no words, so the base rules fail it. Missing language or source: a group of its own. Groups smaller than
``least_rows`` are judged by their language's estimate, small languages by that of all rows. Equal rows are judged
equally. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mailsieve.llm.remember import forget
from mailsieve.llm.words import WHITE, hash_words, utf8, windows
from mailsieve.plans.session import materialize

SYMBOLS = b"#*$%&|<>"
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class QualityRules:
    least_words: int = 50
    most_repeat_percent: int = 50
    #: share of the closest rows that an estimate is made of
    kept_share: float = 0.75
    #: variances of the closest three quarters of normal rows in five dimensions, times this, are those of all rows
    widen: float = 1.412
    #: fall of the logarithm of the determinant below which the steps end
    tolerance: float = 0.001
    least_rows: int = 200
    #: squared distance beyond which a row is an outlier: the 0.9995 quantile of chi-squared with five degrees
    limit: float = 22.1
    #: least standard deviations, which smaller ones are raised to. Where a group has no repeated lines or words, a
    #: text is rejected by those alone beyond 0.3 of its lines and words together (repeated lines repeat words).
    floors: tuple[float, ...] = (0.7, 0.12, 0.5, 0.58, 0.58)


def _repeat_words(texts: list[bytes]) -> np.ndarray:
    """Words that lie in a window of three words which the text holds twice or more."""
    out = np.zeros(len(texts), np.int64)
    for first, hashes, counts in hash_words(texts):
        doc = np.repeat(np.arange(len(counts)), counts)
        tri = windows(hashes, 3)
        if not len(tri):
            continue
        own = doc[:-2] == doc[2:]
        order = np.lexsort((tri, doc[:-2]))
        order = order[own[order]]
        if not len(order):
            continue
        same = (tri[order][1:] == tri[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        at = order[again]
        covered = np.zeros(len(hashes), bool)
        for j in range(3):
            covered[at + j] = True
        out[first:first + len(counts)] = np.bincount(doc[covered], minlength=len(counts))
    return out


def _measure(text: bytes) -> tuple[int, int, int, int, int]:
    bare = text.translate(None, WHITE)
    seen: set[bytes] = set()
    lines = again = 0
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            lines += 1
            again += line in seen
            seen.add(line)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "surrogatepass"))
    return len(text.split()), chars, len(bare) - len(bare.translate(None, SYMBOLS)), again, lines


def statistics(text: Column) -> Column:
    """A struct of ``STATISTICS`` of each whole text (null: no words)."""
    @F.pandas_udf(STATISTICS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 500):  # texts are bytes for a few rows at a time
                texts = [utf8(t) for t in batch[at:at + 500]]
                counted = np.array([_measure(t) for t in texts], np.int64).reshape(-1, 5)
                parts.append(np.column_stack([counted, _repeat_words(texts)]))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
            found = pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 6), np.int64), columns=names)
            yield found[[c.split()[0] for c in STATISTICS.split(", ")]]

    return run(text)


def _vector():
    """Transformed statistics: the logarithms of length, word length, symbols, repeated lines, repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(words.cast("double")),
        F.log(chars / words),
        F.log1p(200.0 * F.col("n_symbols") / chars),
        F.log1p(20.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(20.0 * F.col("n_repeat_words") / words),
    ]


D = 5
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _distance():
    """Squared Mahalanobis distance, from the centre m0.. and the inverse scatter w00.. of the row's group."""
    gaps = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    return sum(((1 if i == j else 2) * F.col(f"w{i}{j}") * gaps[i] * gaps[j] for i, j in _PAIRS), F.lit(0.0))


_NAMES = [f"m{i}" for i in range(D)] + [f"w{i}{j}" for i, j in _PAIRS]


def _estimated(rules: QualityRules):
    """Sums of a key's rows -> centre, inverse scatter, logarithm of the determinant and whether that fell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                n = max(row.n, 1)
                mean = np.array([getattr(row, f"s{i}") for i in range(D)]) / n
                cov = np.zeros((D, D))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = getattr(row, f"q{i}{j}") / n - mean[i] * mean[j]
                cov *= rules.widen
                cov[np.diag_indices(D)] = np.maximum(cov.diagonal(), np.square(rules.floors))
                inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
                rows.append([row.key, row.start, logdet, logdet < row.before - rules.tolerance, *mean, *(inverse[i, j] for i, j in _PAIRS)])
            yield pd.DataFrame(rows, columns=["key", "start", "logdet", "fell", *_NAMES])

    return run, "key string, start int, logdet double, fell boolean, " + ", ".join(f"{n} double" for n in _NAMES)


def _summed(rows: DataFrame, before: Column) -> DataFrame:
    return rows.groupBy("key", "start").agg(
        F.count("*").alias("n"), F.min(before).alias("before"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS])


SALTS = 64


def _salted(groups: DataFrame) -> DataFrame:
    """One copy of each group's row for every salt."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _starts(rows: DataFrame, rules: QualityRules) -> DataFrame:
    quartiles = rows.groupBy("key").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(D)])
    # 1.349 standard deviations of a normal statistic lie between its quartiles
    spread = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(rules.floors[i])) for i in range(D)]
    middle = materialize(quartiles.select(
        "key", F.lit(0).alias("start"), F.lit(float("inf")).alias("logdet"), F.lit(True).alias("fell"),
        *[F.col(f"p{i}")[1].alias(f"m{i}") for i in range(D)],
        *[(1 / (spread[i] * spread[i]) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in _PAIRS]), "mcd")
    placed = rows.join(_salted(middle), ["key", "salt"]).withColumn("reach", F.sqrt(F.greatest(_distance(), F.lit(1e-12)) / D))
    drawn = placed.select("key", F.lit(2).alias("start"), *[(F.col(f"m{i}") + (F.col(f"x{i}") - F.col(f"m{i}")) / F.col("reach")).alias(f"x{i}") for i in range(D)])
    whole = rows.select("key", F.lit(1).alias("start"), *[f"x{i}" for i in range(D)])
    run, schema = _estimated(rules)
    others = _summed(whole.unionByName(drawn), F.lit(float("inf"))).mapInPandas(run, schema)
    return middle.unionByName(others.withColumns({"logdet": F.lit(float("inf")), "fell": F.lit(True)}))


def group_estimates(rows: DataFrame, rules: QualityRules) -> DataFrame:
    """Centre and inverse scatter of least determinant for each ``key`` of rows(key, salt, x0..x4). Rows meet their
    group's values by key and salt, so that a group with all rows is joined in many tasks and then combined before it
    is shuffled. A start whose determinant no longer falls takes no part in later steps.

    What the rows are joined with is written first, so that Spark knows its size and moves the rows only where it is
    large; planned from guesses, each join shuffles them, and the driver holds twice the stages."""
    run, schema = _estimated(rules)
    at = materialize(_starts(rows, rules), "mcd")
    values = F.struct("logdet", *_NAMES).alias("e")
    tried, falling = [], 1
    while falling:
        far = rows.join(_salted(at.select("key", "start", values)), ["key", "salt"]).select("*", "e.*").withColumn("d2", _distance())
        cut = materialize(far.groupBy("key", "start").agg(
            F.percentile_approx("d2", rules.kept_share, 1000).alias("cut"), F.first("e").alias("e")), "mcd")
        near = rows.join(_salted(cut), ["key", "salt"]).select("*", "e.*").withColumn("d2", _distance()).where("d2 <= cut")
        fell = Observation()
        tried.append(materialize(_summed(near, F.col("logdet")).mapInPandas(run, schema).observe(fell, F.count_if("fell").alias("n")), "mcd"))
        falling = fell.get.get("n", 0)
        at = tried[-1].where("fell")
    best = reduce(DataFrame.unionByName, tried).groupBy("key").agg(F.min(F.struct("logdet", "start", *_NAMES)).alias("e"))
    return materialize(best.select("key", *[f"e.{n}" for n in _NAMES]), "mcd")


_LEVELS = ("by_source", "by_lang", "by_all")
_COUNTED = [c.split()[0] for c in STATISTICS.split(", ")]


def measured(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` with the struct ``measured``: statistics, base_failed, transformed statistics and the keys of the
    three levels of grouping."""
    found = docs.withColumn("measured", statistics(F.col("text").cast("string"))).select("*", "measured.*")
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))
    # JSON texts keep a missing part apart from every value
    keys = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("all")
    parts = [*_COUNTED, failed.alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(_vector())],
             *[k.alias(n) for n, k in zip(_LEVELS, keys)]]
    return found.select(*[docs[c] for c in docs.columns], F.struct(*parts).alias("measured"))


def fit(narrow: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Estimates for each group of rows that is large enough, from the columns of ``measured`` of all rows that the
    base rules keep."""
    xs = [f"x{i}" for i in range(D)]
    levels = narrow.where("NOT base_failed").select(F.explode(F.array(*_LEVELS)).alias("key"), F.pmod(F.xxhash64(*xs), F.lit(SALTS)).cast("int").alias("salt"), *xs)
    sizes = levels.groupBy("key").agg(F.count("*").alias("size")).where((F.col("size") >= rules.least_rows) | (F.col("key") == "all"))
    large = _salted(materialize(sizes.select("key"), "groups"))
    return group_estimates(materialize(levels.join(large, ["key", "salt"], "left_semi"), "levels"), rules)


def judged(frame: DataFrame, estimates: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``frame``, which has the columns of ``measured``, with distance2 and kept; the finest estimated level counts."""
    found = frame
    for level in _LEVELS:
        found = found.join(estimates.select(F.col("key").alias(level), F.struct(*[c for c in estimates.columns if c != "key"]).alias(f"e_{level}")), level, "left")
    found = found.withColumn("e", F.coalesce(*[f"e_{level}" for level in _LEVELS])).select("*", "e.*").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= rules.limit, F.lit(True))
    return found.select(*frame.columns, "distance2", kept.alias("kept"))


def with_verdict(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the statistics, base_failed, distance2 and kept, one row for each row of ``docs``."""
    narrow = materialize(measured(docs.select("doc_id", "lang", "source", "text"), rules).select("doc_id", "measured.*"), "statistics")
    return judged(narrow, fit(narrow, rules), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they have. Texts are measured once for the estimates and
    once more beside them, which costs less than moving every text to its verdict."""
    narrow = materialize(measured(docs.select("lang", "source", "text"), rules).select("measured.*"), "statistics")
    wide = measured(docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", "text"), rules).select("row", "measured.*")
    return judged(wide, fit(narrow, rules), rules).where("kept").select("row.*")
