"""Summaries that grow by runs: what was read once is not read again.

    add_states(timing_states(read_results(spark, new_folder)), path, batch="2024-05-01")
    elapsed_trend(read_timing_states(spark, path)).show()

A state is a row for each run (of samples: for each process) with counts, sums and extremes. States of the same run from several
batches add up, so a run may arrive in parts. A batch is written in place of itself: to add it again changes nothing. The results equal those of
`plans.speedup` and `plans.monitor` on all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resamplia.plans.monitor import UNUSUAL_ABOVE, UNUSUAL_BELOW
from resamplia.plans.speedup import RUN_KEYS
from resamplia.sources.files import SCENARIO, TAG_TYPES

_KEYS = [T.StructField(name, TAG_TYPES[name]) for name in RUN_KEYS]


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


_LONG, _DOUBLE = T.LongType(), T.DoubleType()

# Sums of seconds and of their inverses are kept for sequential (s) and parallel (p) rows apart.
TIMING_STATE = T.StructType([
    *_KEYS, T.StructField("num_workers", TAG_TYPES["num_workers"]),
    *_fields(rows=_LONG, s_n=_LONG, s_sum=_DOUBLE, p_n=_LONG, p_sum=_DOUBLE, inverse_n=_LONG, inverse_sum=_DOUBLE),
])
MONITOR_STATE = T.StructType([*_KEYS, *_fields(pid=_LONG, rows=_LONG, max_cpu=_DOUBLE, min_cpu=_DOUBLE)])
SUMS = ("rows", "s_n", "s_sum", "p_n", "p_sum", "inverse_n", "inverse_sum")


def _cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def timing_states(results: DataFrame) -> DataFrame:
    """One row for each run and worker count of clean timing rows."""
    sequential, parallel = F.when(~F.col("parallel"), F.col("elapsed")), F.when(F.col("parallel"), F.col("elapsed"))
    inverse = F.try_divide(F.lit(1.0), parallel)
    states = results.groupBy(*RUN_KEYS, "num_workers").agg(
        F.count("*").alias("rows"), F.count(sequential).alias("s_n"), F.sum(sequential).alias("s_sum"), F.count(parallel).alias("p_n"),
        F.sum(parallel).alias("p_sum"), F.count(inverse).alias("inverse_n"), F.sum(inverse).alias("inverse_sum"),
    )
    return _cast(states, TIMING_STATE)


def monitor_states(samples: DataFrame) -> DataFrame:
    """One row for each process of clean samples."""
    states = samples.groupBy(*RUN_KEYS, "pid").agg(F.count("*").alias("rows"), F.max("pct_cpu").alias("max_cpu"), F.min("pct_cpu").alias("min_cpu"))
    return _cast(states, MONITOR_STATE)


def add_states(states: DataFrame, path: str, batch: str) -> None:
    """Write the states of a batch, in place of an earlier attempt at it. Only what the batch was made from is read."""
    if not batch:
        raise ValueError("a batch needs a name")
    named = states.withColumn("batch", F.lit(batch))
    named.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(path)


def read_timing_states(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TIMING_STATE)


def read_monitor_states(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, MONITOR_STATE)


def _added(names: Sequence[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def count_by(states: DataFrame, keys: Sequence[str] = ("platform", "framework", "backend")) -> DataFrame:
    """Rows of each group, of either kind of states, in the order of the keys."""
    return states.groupBy(*keys).agg(F.sum("rows").alias("n")).orderBy(*keys)


def worker_counts(states: DataFrame) -> DataFrame:
    return states.select("platform", "framework", "backend", "num_workers").distinct()


def elapsed_trend(states: DataFrame, by: Sequence[str] = ("backend", "platform", "framework")) -> DataFrame:
    """Least-squares line of elapsed on parallel (1 = sequential, 2 = parallel) per group. With two places on the axis the line goes through
    the means of both, so sums are all it takes; null without rows of either kind."""
    sums = states.groupBy(*by).agg(*_added(SUMS))
    first, second = F.try_divide("s_sum", "s_n"), F.try_divide("p_sum", "p_n")
    return sums.select(*by, F.col("rows").alias("n"), (second - first).alias("slope"), (2 * first - second).alias("intercept"))


def mean_speed_up(states: DataFrame, by: Sequence[str] = ("backend", "framework"), keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Mean speed-up per group over all pairs of a run's sequential and parallel rows."""
    runs = states.groupBy(*keys).agg(*_added(("s_n", "s_sum", "inverse_n", "inverse_sum")))
    pairs = F.sum(F.col("s_n").cast("double") * F.col("inverse_n"))
    return runs.where("s_n > 0 AND inverse_n > 0").groupBy(*by).agg(
        F.try_divide(F.sum(F.col("s_sum") * F.col("inverse_sum")), pairs).alias("mean")
    )


def cpu_range(states: DataFrame) -> DataFrame:
    return states.groupBy("run", "pid", "framework", "backend").agg(F.max("max_cpu").alias("max_cpu"), F.min("min_cpu").alias("min_cpu"))


def unusual_processes(states: DataFrame) -> DataFrame:
    """Processes that once used very much CPU, or never any."""
    limits = (F.col("max_cpu") > UNUSUAL_ABOVE) | (F.col("max_cpu") < UNUSUAL_BELOW)
    return cpu_range(states).where(limits).drop("max_cpu", "min_cpu")


def first_run(states: DataFrame, by: Sequence[str] = SCENARIO) -> DataFrame:
    """The smallest run of each scenario."""
    return states.groupBy(*by).agg(F.min("run").alias("run"))
