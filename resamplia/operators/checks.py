"""Checks of the assumptions behind the analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a join on them would multiply rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def replicate_sizes(sets: DataFrame) -> DataFrame:
    """(replicate, n): draws per replicate; complete resamples give the same n in all of them."""
    return sets.groupBy("replicate").agg(F.count("*").alias("n"))


def is_dense(df: DataFrame, key: str = "row_ix") -> bool:
    """Does `key` hold every value 0..n-1 exactly once?"""
    found = df.agg(
        F.count("*"), F.count_distinct(key), F.min(key), F.max(key)
    ).first()
    rows, distinct, low, high = found
    return rows == 0 or (rows == distinct and low == 0 and high == rows - 1)
