"""Regression metrics of (truth, estimate) pairs as Spark aggregates.

All four metrics share one aggregation. Rows with a null or NaN on either side must be dropped
first (`complete_pairs`), because the moments below skip nulls column by column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric names in output order, and the estimator label of plain regression metrics.
METRICS = ("rmse", "rsq", "mae", "ccc")
ESTIMATOR = "standard"


def complete_pairs(df: DataFrame) -> DataFrame:
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("truth", "estimate")]
    return df.where(known[0] & known[1])


def metric_aggregates(truth: str = "truth", estimate: str = "estimate") -> list[Column]:
    """rmse, rsq, mae, ccc from Spark's own mergeable moments.

    rsq avoids `corr`, which raises on a constant column under ANSI mode; it is null there.
    """
    y, p = F.col(truth), F.col(estimate)
    error = y - p
    cov, var_y, var_p = F.covar_samp(y, p), F.var_samp(y), F.var_samp(p)
    shift = F.avg(error)
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.try_divide(cov * cov, var_y * var_p).alias("rsq"),
        F.avg(F.abs(error)).alias("mae"),
        F.try_divide(2.0 * cov, var_y + var_p + shift * shift).alias("ccc"),
    ]


def weighted_sums(weight: Column, y: Column, p: Column, error: Column) -> list[Column]:
    """Additive sums behind the metrics for weighted rows; y and p should be centred."""
    terms = {
        "w": weight,
        "wy": weight * y,
        "wp": weight * p,
        "wyy": weight * y * y,
        "wpp": weight * p * p,
        "wyp": weight * y * p,
        "wae": weight * F.abs(error),
        "wse": weight * error * error,
    }
    return [F.sum(value).alias(name) for name, value in terms.items()]


def metrics_from_sums(offset: Column) -> list[Column]:
    """Metrics from `weighted_sums`; `offset` is (centre of y) - (centre of p).

    A variance below the rounding error of its own sums counts as zero, so a column that is
    constant within a resample gives a null rsq, as the unweighted form does.
    """
    w, wy, wp = F.col("w"), F.col("wy"), F.col("wp")

    def central(square: str, a: Column, b: Column) -> Column:
        return F.col(square) - F.try_divide(a * b, w)

    def spread(square: str, total: Column) -> Column:
        value = central(square, total, total)
        return F.when(value > 1e-12 * F.col(square), value).otherwise(0.0)

    freedom = F.when(w > 1, w - 1)
    cov = central("wyp", wy, wp) / freedom
    var_y, var_p = spread("wyy", wy) / freedom, spread("wpp", wp) / freedom
    shift = F.try_divide(wy - wp, w) + offset
    return [
        F.sqrt(F.try_divide(F.col("wse"), w)).alias("rmse"),
        F.try_divide(cov * cov, var_y * var_p).alias("rsq"),
        F.try_divide(F.col("wae"), w).alias("mae"),
        F.try_divide(2.0 * cov, var_y + var_p + shift * shift).alias("ccc"),
    ]


def to_long(wide: DataFrame, keys: Sequence[str] = (), names: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric: keys, metric, estimator, estimate."""
    pairs = ", ".join(f"'{name}', `{name}`" for name in names)
    return wide.select(
        *keys, F.expr(f"stack({len(names)}, {pairs}) AS (metric, estimate)")
    ).select(*keys, "metric", F.lit(ESTIMATOR).alias("estimator"), "estimate")
