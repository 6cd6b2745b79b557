"""Scans along an order within groups, without one task per group.

The order is cut into ranges (`operators.ordered.find_ranges`). Within a group and range Spark's windows do the work; what crosses a
border is one row for each group and range, scanned in turn. A group that holds most of the rows is as many pieces as there are
ranges, and rows with equal order values are never parted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resamplia.operators.joins import inner_join_nulls_match, small_side
from resamplia.operators.ordered import Ranges, find_ranges

RANGE = "_range"


def ranged(df: DataFrame, order: str, ranges: Ranges | None = None) -> DataFrame:
    """`df` with the number of the range of `order`, a number without nulls."""
    return df.withColumn(RANGE, (ranges or find_ranges(df.select(order), order)).number(order))


def _before(rows: DataFrame, by: Sequence[str], summary: Sequence[Column], carried: dict[str, Column]) -> DataFrame:
    """`rows` with what `carried` makes of the summaries of the ranges before, for each group."""
    ends = rows.groupBy(*by, RANGE).agg(*summary)
    # One row per group and range: no group has more than there are ranges.
    borders = ends.select(*by, RANGE, *[c.alias(name) for name, c in carried.items()])
    return inner_join_nulls_match(rows, small_side(borders), [*by, RANGE])


def with_previous(rows: DataFrame, by: Sequence[str], order: str, value: str, previous: str) -> DataFrame:
    """`rows` (see `ranged`; one for each group and `order`) with the `value` of the row before in the group; null in the first."""
    groups = Window.partitionBy(*by).orderBy(RANGE)
    out = _before(rows, by, [F.max_by(value, order).alias("_last")], {"_carried": F.lag("_last").over(groups)})
    inside = Window.partitionBy(*by, RANGE).orderBy(order)
    first = F.row_number().over(inside) == 1
    return out.withColumn(previous, F.when(first, F.col("_carried")).otherwise(F.lag(value).over(inside))).drop("_carried")


def with_running_sum(rows: DataFrame, by: Sequence[str], order: str, value: str, total: str) -> DataFrame:
    """`rows` (see `ranged`; one for each group and `order`) with the sum of `value` up to and including the row."""
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    out = _before(rows, by, [F.sum(value).alias("_sum")], {"_carried": F.coalesce(F.sum("_sum").over(before), F.lit(0))})
    inside = Window.partitionBy(*by, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn(total, F.col("_carried") + F.sum(value).over(inside)).drop("_carried")
