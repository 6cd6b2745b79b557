"""Joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Largest counted number of rows, and of bytes, that a join side may have to be broadcast.
SMALL_ROWS = 500_000
SMALL_BYTES = 64 << 20

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def counted_size(df: DataFrame) -> tuple[int, int]:
    """Rows of `df`, and bytes that they take at most: 16 for each column, and the longest value of those without a fixed width."""
    loose = [f.name for f in df.schema.fields if not isinstance(f.dataType, _FIXED)]
    longest = [F.coalesce(F.max(F.octet_length(F.col(f"`{c}`").cast("string"))), F.lit(0)) for c in loose]
    rows, *widths = df.agg(F.count("*"), *longest).first()
    return rows, rows * (16 * len(df.columns) + sum(widths))


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Few enough rows and bytes to be broadcast, as counted?"""
    n, used = counted_size(df)
    return n <= (SMALL_ROWS if rows is None else rows) and used <= (SMALL_BYTES if size is None else size)


_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """`df`, kept in memory or on the executors' disks once it is computed; what is lost with an executor is computed again.
    Results are lazy, so only the caller knows when such tables are needed no more: see `release`."""
    _kept.append(df.persist())
    return df


def release() -> int:
    """Give up all tables that this library keeps; results that still need one compute it again. Returns their number."""
    n = len(_kept)
    while _kept:
        table = _kept.pop()
        if not table.sparkSession.sparkContext._jsc.sc().isStopped():
            table.unpersist()
    return n


def small_side(df: DataFrame) -> DataFrame:
    """A derived table for the small side of a join, broadcast if its counted rows and bytes are few.

    Spark cannot know the size of an aggregate beforehand and would shuffle the large side as
    well. The table is kept (see `kept`). Above SMALL_ROWS or SMALL_BYTES it is joined by a shuffle, in which adaptive execution splits
    hot keys.
    """
    table = kept(df)
    return F.broadcast(table) if is_small(table) else table


def inner_join_nulls_match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner (or left) join on equal keys where null equals null; keys appear once.

    Null-safe equality still hashes or sorts on the keys. Without a hint, Spark picks the
    strategy by measured size and splits skewed keys.
    """
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_right_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])
