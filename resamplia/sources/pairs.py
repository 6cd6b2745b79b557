"""Observed/predicted tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resamplia.operators.joins import small_side


def observed_predicted(
    df: DataFrame,
    truth: str | Column,
    estimate: str | Column,
    row_ix: str | Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """(row_ix, *by, truth, estimate) from any table with two numeric columns."""

    def column(value: str | Column) -> Column:
        return F.col(value) if isinstance(value, str) else value

    return df.select(
        column(row_ix).cast("bigint").alias("row_ix"),
        *by,
        column(truth).cast("double").alias("truth"),
        column(estimate).cast("double").alias("estimate"),
    )


def dense_index(df: DataFrame, name: str = "row_ix") -> DataFrame:
    """Number the rows of a scan of files 0..n-1, without a sort, a copy or a shuffle of rows.

    A row's number is its place in its file plus the number of rows in the files before, by path; it is the same
    in every attempt and for every partitioning. `df` may select and rename columns of a file scan; for other tables,
    number a unique key with `operators.ordered.dense_codes`.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    files = placed.groupBy("_file").agg(F.count("*").alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(small_side(files), "_file").select(*df.columns, (F.col("_offset") + F.col("_row")).alias(name))
