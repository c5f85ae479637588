"""Positions and running sums in a sorted table, without one task that sees the whole of a group.

Rows are dealt to tasks by ranges of their order and sorted there; each range is summed, the sums of the ranges before
give the offset of a range. A group of any size is spread over as many ranges as its rows fill. The sorted table is
written once, because ranges are cut from a sample and may fall elsewhere when they are computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.plans.session import materialize

_ROW_BITS = 33


def sorted_rows(frame: DataFrame, order: Sequence[Column | str], label: str,
                then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``frame`` written in the order given, with ``_part`` (ascending along the order) and ``_row`` (ascending in it).
    ``then`` may change the sorted rows, in their order, before they are written."""
    at = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    at = at.withColumns({"_part": F.shiftrightunsigned("_id", _ROW_BITS), "_row": F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_id")
    return materialize(at if then is None else then(at), label)


def beside(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the columns ``names``, nulls being equal to each other; the columns of ``left``, then the others of ``right``."""
    right = right.select([F.col(c).alias(f"_key_{c}" if c in names else c) for c in right.columns])
    on = F.lit(True)
    for name in names:
        on = on & F.col(name).eqNullSafe(F.col(f"_key_{name}"))
    return left.join(right, on, how).drop(*[f"_key_{n}" for n in names])


def range_offsets(table: DataFrame, groups: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """For each group and range of ``table`` (from ``sorted_rows``): its first row, the group's rows before it
    (``_offset``), the group's rows (``_size``) and for each of ``sums`` the group's sum before it (``_before_*``)."""
    ranges = table.groupBy(*groups, "_part").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(
        *groups, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_size"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums])


def with_offsets(table: DataFrame, offsets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The rows of ``table`` beside those of their group and range in ``offsets``, with ``position`` (from 0) in the group."""
    return beside(table, offsets, [*groups, "_part"]).withColumn("position", F.col("_offset") + F.col("_row") - F.col("_first"))


def running(frame: DataFrame, groups: Sequence[str], order: Sequence[Column | str], sums: Sequence[str], label: str) -> DataFrame:
    """``frame`` with ``position`` (from 0) and, for each column s of ``sums``, ``before_s``: its sum over the rows of
    the group that come before."""
    table = sorted_rows(frame, [*groups, *order], label)
    rows = with_offsets(table, range_offsets(table, groups, sums), groups)
    earlier = Window.partitionBy(*groups, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    found = {f"before_{s}": F.col(f"_before_{s}") + F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums}
    return rows.withColumns(found).select(*frame.columns, "position", *found)
