"""Analysis of timing rows: baseline join, speed-ups, trend, best configuration.

A timing row has elapsed, parallel, run, num_workers, framework, backend, platform.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resamplia.operators.joins import inner_join_nulls_match, small_side

RUN_KEYS = ("run", "framework", "backend", "platform")
RUN_KEYS_ONE_PLATFORM = ("run", "framework", "backend")


def count_by(df: DataFrame, keys: Sequence[str] = ("platform", "framework", "backend")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def worker_counts(results: DataFrame) -> DataFrame:
    return results.select("platform", "framework", "backend", "num_workers").distinct()


def first_worker_count(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """num_workers of the first row in the given order, as one row; no sort. Of rows that are equal in that
    order the smallest num_workers counts."""
    return rows.agg(F.min_by("num_workers", F.struct(*order, F.col("num_workers"))).alias("num_workers"))


def baseline(results: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Sequential times."""
    return results.where(~F.col("parallel")).select(F.col("elapsed").alias("baseline"), *keys)


# Sequential and parallel rows of a run that meet in one task.
CELL_ROWS = 100_000


def _dealt(timed: DataFrame, large: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the runs `large` (keys, _rows, _columns), each with the cells (_row, _column) in which it meets the others of its run.

    Each parallel row is in one grid row and all its columns, each sequential row in one column and all its rows, so every two meet once.
    Equal rows are counted before they are moved, and the copies dealt out evenly: no row decides its place by chance.
    """
    sized = inner_join_nulls_match(timed, large, keys)
    counted = sized.groupBy(*timed.columns, "_rows", "_columns").agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_own", F.xxhash64(*timed.columns))

    def share(n: str) -> Column:
        """(part, copies): the copies of a row over n parts, from a part that its hash says."""
        part = lambda k: F.struct(k.alias("part"), F.expr("_n").alias("n"), F.pmod(k - F.pmod("_own", F.col(n)), F.col(n)).alias("turn"))
        copies = lambda x: F.struct(x["part"], F.floor((x["n"] + F.col(n) - 1 - x["turn"]) / F.col(n)).alias("copies"))
        parts = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: copies(part(k)))
        return F.filter(parts, lambda x: x["copies"] > 0)

    def every(n: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct(k.alias("part"), F.lit(1).cast("bigint").alias("copies")))

    rows = F.when(F.col("parallel"), share("_rows")).otherwise(every("_rows"))
    columns = F.when(F.col("parallel"), every("_columns")).otherwise(share("_columns"))
    placed = counted.withColumn("_r", F.explode(rows)).withColumn("_c", F.explode(columns))
    return placed.select(*timed.columns, F.col("_r.part").alias("_row"), F.col("_c.part").alias("_column"), (F.col("_r.copies") * F.col("_c.copies")).alias("_copies"))


def _pairs(cells: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Parallel rows with each sequential time of their cell, and the number of such pairs."""
    cell = Window.partitionBy(*keys, *[c for c in ("_row", "_column") if c in cells.columns])
    own = F.col("_copies") if "_copies" in cells.columns else F.lit(1).cast("bigint")
    sequential = F.collect_list(F.when(~F.col("parallel"), F.struct(F.col("elapsed").alias("baseline"), own.alias("copies")))).over(cell)
    met = cells.withColumn("_sequential", sequential).where("parallel").withColumn("_one", F.explode("_sequential"))
    return met.select(*columns, F.col("_one.baseline").alias("baseline"), (own * F.col("_one.copies")).alias("_pairs"))


def speed_ups(results: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Every parallel row with each sequential time of its run; null keys match.

    The speed-up of an elapsed time of 0 is null. Timing rows are shuffled once, on their run: both kinds are taken from there instead of
    a join of the table with itself. A run of more than CELL_ROWS rows of either kind is dealt out to a grid of tasks. Averages
    need no pairs, see `mean_speed_up`.
    """
    timed = results.where(F.col("parallel").isNotNull())
    parts = {"_rows": F.col("parallel"), "_columns": ~F.col("parallel")}
    sizes = timed.groupBy(*keys).agg(*[F.ceil(F.count_if(c) / F.lit(CELL_ROWS)).cast("int").alias(n) for n, c in parts.items()])
    # Few runs can be so large; counting them moves a row for each run and task.
    large = small_side(sizes.where("(_rows > 1 or _columns > 1) and _rows > 0 and _columns > 0"))
    if large.limit(1).count() == 0:
        pairs = _pairs(timed, results.columns, keys).drop("_pairs")
    else:
        small = inner_join_nulls_match(timed, large.select(*keys), keys, "left_anti")
        hot = _pairs(_dealt(timed, large, keys), results.columns, keys)
        copies = hot.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_pairs"))))
        pairs = _pairs(small, results.columns, keys).drop("_pairs").unionByName(copies.drop("_pairs", "_copy"))
    return (
        pairs.withColumn("speed_up", F.try_divide("baseline", "elapsed"))
        .withColumn("log2_speed_up", F.when(F.col("speed_up") > 0, F.log2("speed_up")))
    )


def speed_ups_with_workers(results: DataFrame) -> DataFrame:
    """Speed-ups beside every worker count seen on their platform."""
    lines = results.select("platform", F.col("num_workers").alias("ideal")).distinct()
    return inner_join_nulls_match(speed_ups(results), small_side(lines), ["platform"])


def mean_speed_up(
    results: DataFrame,
    by: Sequence[str] = ("backend", "framework"),
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Mean speed-up per group, without forming the joined pairs.

    Over all pairs of one run, the sum of baseline / elapsed is (sum of baseline) times
    (sum of 1 / elapsed), so one aggregation per run replaces the self-join.
    """
    base = F.when(~F.col("parallel"), F.col("elapsed"))
    inverse = F.when(F.col("parallel"), F.try_divide(F.lit(1.0), F.col("elapsed")))
    runs = results.groupBy(*keys).agg(
        F.sum(base).alias("base"),
        F.count(base).alias("base_n"),
        F.sum(inverse).alias("inverse"),
        F.count(inverse).alias("inverse_n"),
    )
    pairs = F.sum(F.col("base_n").cast("double") * F.col("inverse_n"))
    return (
        runs.where("base_n > 0 AND inverse_n > 0")
        .groupBy(*by)
        .agg(F.try_divide(F.sum(F.col("base") * F.col("inverse")), pairs).alias("mean"))
    )


def best_configurations(means: DataFrame) -> DataFrame:
    """Rows with the largest mean, ties kept. Means are few rows: they are ranked in one pass."""
    ranked = means.where("mean is not null").withColumn("_rank", F.rank().over(Window.orderBy(F.desc("mean"))))
    return ranked.where("_rank = 1").drop("_rank")


def best_speed_up(
    results: DataFrame, by: Sequence[str] = ("backend", "framework"), keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """The largest mean speed-up, rounded half to even, as one row."""
    return mean_speed_up(results, by, keys).agg(F.bround(F.max("mean"), 1).alias("best_speed_up"))


def elapsed_trend(results: DataFrame, by: Sequence[str] = ("backend", "platform", "framework")) -> DataFrame:
    """Least-squares line of elapsed on parallel (1 = sequential, 2 = parallel) per group."""
    x = F.when(F.col("parallel"), 2.0).when(~F.col("parallel"), 1.0)
    return results.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope("elapsed", x).alias("slope"),
        F.regr_intercept("elapsed", x).alias("intercept"),
    )
