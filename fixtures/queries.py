"""One query per operator, over the given tables. `fixtures.oracle` has the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures import views
from resamplia.functions.metrics import METRICS, complete_pairs, metric_aggregates, to_long
from resamplia.functions.scalars import epoch_seconds, file_path, without
from resamplia.functions.states import QuantileMetric, Rows, SumMetric
from resamplia.operators import checks, ordered
from resamplia.operators.joins import kept
from resamplia.operators.store import new_folder
from resamplia.plans import bootstrap, increments, monitor, speedup
from resamplia.plans.set_metrics import set_metrics
from resamplia.plans.sketches import percentile_bounds
from resamplia.sources import files
from resamplia.sources.pairs import dense_index

SEED = 7

# The mean absolute errors are fractions with a denominator up to 10^7, whose mean can be an exact tie
# at 6 digits; at 8 digits it is exact.
CI_DIGITS = 8

# Replicates of every bootstrap query.
TIMES = 5000


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def time_us(column: str = "time") -> Column:
    return F.unix_micros(column)


def results(spark: SparkSession, folder: str) -> DataFrame:
    return files.clean_results(views.results(spark, folder))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return files.clean_monitor(views.monitor(spark, folder))


# Metrics and bootstrap


def metrics_wide(spark: SparkSession, folder: str) -> DataFrame:
    pairs = complete_pairs(views.model_pairs(spark, folder))
    return rounded(pairs.agg(*metric_aggregates()), 6, *METRICS)


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    pairs = complete_pairs(views.model_pairs(spark, folder))
    return rounded(to_long(pairs.agg(*metric_aggregates())), 6, "estimate")


def metrics_by_model(spark: SparkSession, folder: str) -> DataFrame:
    pairs = complete_pairs(views.pairs(spark, folder))
    return rounded(pairs.groupBy("model").agg(*metric_aggregates()), 6, *METRICS)


def drawn_rows(spark: SparkSession, folder: str) -> DataFrame:
    return bootstrap.analysis_sets(views.model_pairs(spark, folder), TIMES, SEED)


def bootstrap_draws(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document was drawn, and the values drawn with it."""
    drawn = bootstrap.analysis_sets(views.model_pairs(spark, folder), TIMES, SEED, copy="copy")
    # A replicate has a first copy of each row that it draws.
    return drawn.groupBy("row_ix").agg(
        F.count("*").alias("n"), F.count_if(F.col("copy") == 1).alias("replicates"), F.sum("truth").alias("truth"), F.sum("estimate").alias("estimate")
    )


def bootstrap_draw_counts(spark: SparkSession, folder: str) -> DataFrame:
    return checks.replicate_sizes(drawn_rows(spark, folder))


def replicate_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Replicates of each model in the table of scores, and the draws behind them."""
    return scored_by_model(spark, folder).groupBy("model").agg(
        F.count("*").alias("replicates"), F.count("rmse").alias("scored"), F.min("n").alias("smallest"), F.max("n").alias("largest")
    )


def scored(spark: SparkSession, folder: str, times: int = TIMES, first: int = 1) -> DataFrame:
    pairs = views.model_pairs(spark, folder)
    return bootstrap.bootstrap_metrics(pairs, times, SEED, first=first)


def bootstrap_first_split(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(to_long(scored(spark, folder, 1)), 6, "estimate")


def bootstrap_last_split(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(to_long(scored(spark, folder, TIMES, TIMES), ["replicate"]), 6, "estimate")


def bootstrap_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(to_long(scored(spark, folder), ["replicate"]), 6, "estimate")


def scored_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return bootstrap.bootstrap_metrics(views.pairs(spark, folder), TIMES, SEED, by=["model"])


def bootstrap_metrics_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scored_by_model(spark, folder), 6, *METRICS)


def bootstrap_rare_model(spark: SparkSession, folder: str) -> DataFrame:
    """A model without any usable row in many replicates: these have null metrics."""
    scores = bootstrap.bootstrap_metrics(views.rare_pairs(spark, folder), TIMES, SEED, by=["model"])
    return rounded(scores, 6, *METRICS)


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    scores = to_long(scored(spark, folder), ["replicate"])
    bounds = bootstrap.percentile_ci(scores, ["metric", "estimator"])
    return rounded(bounds, CI_DIGITS, "lower", "mean", "upper")


def bootstrap_ci_by_model(spark: SparkSession, folder: str) -> DataFrame:
    scores = to_long(scored_by_model(spark, folder), ["replicate", "model"])
    bounds = bootstrap.percentile_ci(scores, ["model", "metric"])
    return rounded(bounds, CI_DIGITS, "lower", "mean", "upper")


def bootstrap_ci_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Do the limits of small sketches enclose the exact limits, as far in ranks as they say? The scores are ranked by counting."""
    # Read three times, made once: a row per replicate and model.
    scores = to_long(kept(scored_by_model(spark, folder)), ["replicate", "model"])
    keys = ["model", "metric"]
    found = percentile_bounds(scores, keys, size=128).where("replicates > 0")
    exact = bootstrap.percentile_ci(scores, keys).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("lower").alias("low"), F.col("upper").alias("high"))
    met = found.join(exact, [F.col(c) == F.col(f"_{c}") for c in keys]).drop(*[f"_{c}" for c in keys])
    of = scores.select(*[F.col(c).alias(f"_{c}") for c in keys], "estimate")
    ranked = met.join(of, [F.col(c) == F.col(f"_{c}") for c in keys])

    def below(bound: str, strict: bool) -> Column:
        return F.count_if((F.col("estimate") < F.col(bound)) if strict else (F.col("estimate") <= F.col(bound)))

    counts = ranked.groupBy(*keys, "replicates", "rank_error", "lower", "upper", "low", "high").agg(
        below("lower.low", True).alias("a"), below("lower.high", False).alias("b"), below("upper.low", True).alias("c"), below("upper.high", False).alias("d")
    )
    # Either limit is at most twice the stated error and the weight of one number away from its rank.
    slack = 2 * F.col("rank_error") * F.col("replicates") + 2 * F.col("replicates") / 128 + 1
    near = lambda rank, q: F.abs(rank - q * F.col("replicates")) <= slack
    return counts.select(
        *keys, "replicates", ((F.col("lower.low") <= F.col("low")) & (F.col("low") <= F.col("lower.high"))).alias("lower_enclosed"),
        ((F.col("upper.low") <= F.col("high")) & (F.col("high") <= F.col("upper.high"))).alias("upper_enclosed"),
        # A value that very many scores share has no rank of its own.
        F.when(F.col("lower.low") < F.col("lower.high"), near(F.col("a"), 0.025) & near(F.col("b"), 0.025)).otherwise(True).alias("lower_near"),
        F.when(F.col("upper.low") < F.col("upper.high"), near(F.col("c"), 0.975) & near(F.col("d"), 0.975)).otherwise(True).alias("upper_near"),
        (F.col("rank_error") <= 0.05).alias("small_error"),
    )


def bootstrap_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics from drawn rows, as a user's own aggregates would get them."""
    scores = drawn_rows(spark, folder).groupBy("replicate").agg(*metric_aggregates())
    return rounded(scores, 6, *METRICS)


def bootstrap_scan_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Draws per replicate and model."""
    sets = bootstrap.analysis_sets(views.pairs(spark, folder), TIMES, SEED, by=["model"])
    return sets.groupBy("replicate", "model").agg(F.count("*").alias("n"))


def bootstrap_gather(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of sets from the other random stream."""
    sets = bootstrap.gathered_sets(views.model_pairs(spark, folder), TIMES, SEED)
    return rounded(sets.groupBy("replicate").agg(*metric_aggregates()), 6, *METRICS)


def bootstrap_poisson(spark: SparkSession, folder: str) -> DataFrame:
    pairs = views.pairs(spark, folder)
    return rounded(bootstrap.poisson_metrics(pairs, TIMES, SEED, by=["model"]), 6, *METRICS)


def bootstrap_udf(spark: SparkSession, folder: str) -> DataFrame:
    """A user's own sums: squared error, and rows predicted within a tenth."""

    # Nested functions travel to the workers by value: they need not import this module.
    def parts(rows: Rows, weight: np.ndarray) -> list[float]:
        error = np.abs(rows["truth"] - rows["estimate"])
        return [weight.sum(), (weight * error * error).sum(), weight[error <= 0.1 * rows["truth"]].sum()]

    def result(sums: list[float]) -> dict[str, float]:
        n, squared, close = sums
        return {"rmse": (squared / n) ** 0.5, "within_tenth": close / n}

    metric = SumMetric(["rmse", "within_tenth"], parts, result)
    return rounded(set_metrics(views.model_pairs(spark, folder), TIMES, SEED, metric), 6, *metric.names)


def median_error() -> QuantileMetric:
    return QuantileMetric("median_error", lambda rows: abs(rows["truth"] - rows["estimate"]))


def bootstrap_median_error(spark: SparkSession, folder: str) -> DataFrame:
    """The median of |error| of each resample, exactly."""
    return set_metrics(views.model_pairs(spark, folder), TIMES, SEED, median_error())


def bootstrap_median_error_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return set_metrics(views.pairs(spark, folder), TIMES, SEED, median_error(), by=["model"])


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ordered.roc_auc(views.quality_scores(spark, folder), "truth", "score"), 9, "roc_auc")


def bootstrap_auc(spark: SparkSession, folder: str) -> DataFrame:
    scores = bootstrap.bootstrap_auc(views.quality_pairs(spark, folder), TIMES, SEED)
    return rounded(scores, 9, "roc_auc")


def bootstrap_auc_ci(spark: SparkSession, folder: str) -> DataFrame:
    scores = bootstrap.bootstrap_auc(views.quality_pairs(spark, folder), TIMES, SEED)
    long = to_long(scores, ["replicate"], ["roc_auc"])
    return rounded(bootstrap.percentile_ci(long), 9, "lower", "mean", "upper")


def indexed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Dense numbering of a table without a usable key."""
    indexed = dense_index(views.table(spark, folder, "lineitem").select("l_quantity"))
    return indexed.agg(
        F.count("*").alias("n"),
        F.count_distinct("row_ix").alias("distinct_rows"),
        F.min("row_ix").alias("first"),
        F.max("row_ix").alias("last"),
        F.sum("l_quantity").alias("quantity"),
    )


# Timing rows

RESULT_COLUMNS = ["run", "framework", "backend", "platform"]


def results_tagged(spark: SparkSession, folder: str) -> DataFrame:
    times = views.table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("elapsed"), F.col("l_quantity").alias("user_self")
    )
    return files.with_tags(
        times,
        parallel=False,
        run=7,
        num_workers=8,
        framework="future",
        backend="mirai",
        platform="source",
    )


def results_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = results(spark, folder).select("run", "parallel", "elapsed", "user_self", "sys_self")
    sequential, parallel = rows.where("NOT parallel"), rows.where("parallel").drop("sys_self")
    return files.bind_rows(sequential, parallel)


def num_workers_first(spark: SparkSession, folder: str) -> DataFrame:
    """Of the first sample, in the order in which scenarios are listed."""
    order = ["platform", "framework", "backend", "run", "time", "pid"]
    return speedup.first_worker_count(samples(spark, folder), order)


def best_speed_up_no_platform(spark: SparkSession, folder: str) -> DataFrame:
    return speedup.best_speed_up(results(spark, folder), keys=speedup.RUN_KEYS_ONE_PLATFORM)


def files_stacked(spark: SparkSession, folder: str) -> DataFrame:
    """Files found by name, stacked with their names as a column; two words find the documents."""
    return files.stack_named(spark, folder, ["documents", "labels", "document"], ["doc_id"])


def results_rewritten(spark: SparkSession, folder: str) -> DataFrame:
    """A table of runs, of which some are written again with other times, and one twice."""
    path = new_folder(spark, "results-rewritten")
    times = views.batch_times(spark, folder)
    unique = [*speedup.RUN_KEYS, "parallel"]
    files.replace_runs(times, path, unique)
    again = times.where("run % 3 = 0").withColumn("elapsed", 2 * F.col("elapsed"))
    for _ in range(2):
        files.replace_runs(again, path, unique)
    schema = T.StructType([f for f in times.schema.fields if f.name not in files.RUN_FOLDERS] + [T.StructField(c, files.TAG_TYPES[c]) for c in files.RUN_FOLDERS])
    return files.read_runs(spark, path, schema)


def saved_monitor(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The samples of each run in a file of their own."""
    root = new_folder(spark, "monitors")
    rows = views.monitor(spark, folder).drop("main_pid")
    for run in range(1, 6):
        files.save_monitor(rows.where(F.col("run") == run), 100 + run, root, files.run_suffix("all", "all", run))
    return root, files.read_monitor(spark, root)


def monitor_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Samples written run by run with the process id that belongs to each file, and read back."""
    _, rows = saved_monitor(spark, folder)
    return rows.select("run", "pid", time_us().alias("time_us"), "pct_cpu", "platform", "num_workers", "main_pid")


def monitor_main_pid_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """The process id of each file from a file beside it; that of run 3 has none."""
    root, _ = saved_monitor(spark, folder)
    for run in (1, 2, 4, 5):
        files.save_sidecar(spark, 200 + run, root, files.run_suffix("all", "all", run))
    rows = files.read_monitor_files(spark, root)
    return rows.select("file", "run", "pid", time_us().alias("time_us"), "pct_cpu", "main_pid")


def timing_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Named numbers, here totals of the lines, as one tagged row."""
    times = views.table(spark, folder, "lineitem").agg(F.sum("l_quantity").alias("elapsed"), F.max("l_tax").alias("sys_self"))
    return files.timing_row(spark, times.first().asDict(), run=7, parallel=True, framework="future")


def result_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The file of each run of each scenario."""
    name = F.concat_ws("-", F.lit("res"), "backend", "platform", "run")
    runs = results(spark, folder).select("backend", "platform", "run").distinct()
    return runs.select("backend", "platform", "run", file_path("results", name).alias("path"))


def results_count_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The counts with the number of their row as it is given out."""
    rows = speedup.count_by(results(spark, folder))
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


def timing_batches(spark: SparkSession, folder: str) -> DataFrame:
    """States of the timing rows in three batches, one of them written twice; the lines of a run are in several."""
    path, rows = new_folder(spark, "timing-states"), results(spark, folder)
    for batch in (0, 1, 2, 1):
        part = rows.where(F.pmod(F.col("user_self").cast("long"), F.lit(3)) == batch)
        increments.add_states(increments.timing_states(part), path, f"batch-{batch}")
    return increments.read_timing_states(spark, path)


def monitor_batches(spark: SparkSession, folder: str) -> DataFrame:
    path, rows = new_folder(spark, "monitor-states"), samples(spark, folder)
    for batch in (0, 1, 0):
        part = rows.where(F.dayofmonth("time") % 2 == batch)
        increments.add_states(increments.monitor_states(part), path, f"days-{batch}")
    return increments.read_monitor_states(spark, path)


def elapsed_trend_merged(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(increments.elapsed_trend(timing_batches(spark, folder)), 4, "slope", "intercept")


def mean_speed_up_merged(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(increments.mean_speed_up(timing_batches(spark, folder)), 6, "mean")


def results_count_merged(spark: SparkSession, folder: str) -> DataFrame:
    return increments.count_by(timing_batches(spark, folder))


def cpu_range_merged(spark: SparkSession, folder: str) -> DataFrame:
    return increments.cpu_range(monitor_batches(spark, folder))


def cpu_outliers_merged(spark: SparkSession, folder: str) -> DataFrame:
    return increments.unusual_processes(monitor_batches(spark, folder))


def speed_ups(spark: SparkSession, folder: str) -> DataFrame:
    ups = speedup.speed_ups(results(spark, folder))
    return rounded(
        ups.select(*RESULT_COLUMNS, "num_workers", "elapsed", "baseline", "speed_up", "log2_speed_up"),
        9,
        "log2_speed_up",
    )


def speed_ups_no_platform(spark: SparkSession, folder: str) -> DataFrame:
    ups = speedup.speed_ups(results(spark, folder), speedup.RUN_KEYS_ONE_PLATFORM)
    return ups.select(*RESULT_COLUMNS, "elapsed", "baseline", "speed_up")


def speed_ups_with_workers(spark: SparkSession, folder: str) -> DataFrame:
    ups = speedup.speed_ups_with_workers(results(spark, folder))
    return ups.select(*RESULT_COLUMNS, "elapsed", "baseline", "speed_up", "ideal")


def mean_speed_up(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(speedup.mean_speed_up(results(spark, folder)), 6, "mean")


def mean_speed_up_backend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(speedup.mean_speed_up(results(spark, folder), by=["backend"]), 6, "mean")


def best_configuration(spark: SparkSession, folder: str) -> DataFrame:
    means = speedup.mean_speed_up(results(spark, folder))
    return rounded(speedup.best_configurations(means), 6, "mean")


def duplicate_run_keys(spark: SparkSession, folder: str) -> DataFrame:
    base = speedup.baseline(results(spark, folder))
    return checks.duplicate_keys(base, speedup.RUN_KEYS)


def elapsed_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(speedup.elapsed_trend(results(spark, folder)), 4, "slope", "intercept")


def elapsed_trend_no_platform(spark: SparkSession, folder: str) -> DataFrame:
    trend = speedup.elapsed_trend(results(spark, folder), ["backend", "framework"])
    return rounded(trend, 4, "slope", "intercept")


# CPU samples


def monitor_clean(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).withColumn("time", time_us()).withColumnRenamed("time", "time_us")


def monitor_main_pid(spark: SparkSession, folder: str) -> DataFrame:
    """The process id of each run from a table of its own, which lacks one of the runs."""
    nations = views.table(spark, folder, "nation").where("n_nationkey between 1 and 4")
    main_pids = nations.select(F.col("n_nationkey").alias("run"), (100 + F.col("n_regionkey")).alias("main_pid"))
    joined = files.attach_main_pid(samples(spark, folder).drop("main_pid"), main_pids, ["run"])
    return joined.select("run", "pid", time_us().alias("time_us"), "pct_cpu", "main_pid")


def monitor_rel_time(spark: SparkSession, folder: str) -> DataFrame:
    rows = monitor.relative_time(views.monitor(spark, folder))
    at = epoch_seconds(F.col("time")).alias("epoch_seconds")
    columns = ["run", "pid", "framework", "backend", "platform", at, "pct_cpu", "rel_time"]
    return rounded(rows.select(*columns), 9, "rel_time")


def worker_panel(spark: SparkSession, folder: str) -> DataFrame:
    panel = monitor.worker_panel(samples(spark, folder), "future", "mirai", ["unix"])
    return panel.select("run", "pid", "code", time_us().alias("time_us"), "min_sec", "pct_cpu", "worker")


def labels_of_panel(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.labels_of_panel(samples(spark, folder), "future", "mirai", ["unix", "macOS"])


def single_run(spark: SparkSession, folder: str) -> DataFrame:
    rows = monitor.single_run(samples(spark, folder), "foreach/doFuture/%dopar%", 3)
    return rows.select("run", "pid", time_us().alias("time_us"), "pct_cpu", "backend", "platform")


def busy_workers(spark: SparkSession, folder: str) -> DataFrame:
    slots = monitor.busy_workers(samples(spark, folder), "1 hour", 50.0)
    return slots.select(time_us("start").alias("start_us"), "busy", "samples")


def idle_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(monitor.idle_share(samples(spark, folder), 5.0), 6, "idle_share")


def busy_at_moments(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.busy_at_moments(samples(spark, folder), 50.0)


def busy_peak(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(monitor.busy_peak(samples(spark, folder), 50.0), 9, "mean_busy")


def idle_periods(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.idle_periods(samples(spark, folder), 30.0)


def package_names(spark: SparkSession, folder: str) -> DataFrame:
    part = views.table(spark, folder, "part")
    return part.select("p_partkey", without(F.col("p_name"), "small ").alias("name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "metrics_wide": metrics_wide,
    "metrics_long": metrics_long,
    "metrics_by_model": metrics_by_model,
    "bootstrap_draws": bootstrap_draws,
    "bootstrap_draw_counts": bootstrap_draw_counts,
    "replicate_completeness": replicate_completeness,
    "bootstrap_first_split": bootstrap_first_split,
    "bootstrap_last_split": bootstrap_last_split,
    "bootstrap_metrics": bootstrap_metrics,
    "bootstrap_metrics_by_model": bootstrap_metrics_by_model,
    "bootstrap_rare_model": bootstrap_rare_model,
    "bootstrap_ci": bootstrap_ci,
    "bootstrap_ci_by_model": bootstrap_ci_by_model,
    "bootstrap_ci_sketch": bootstrap_ci_sketch,
    "bootstrap_scan": bootstrap_scan,
    "bootstrap_scan_counts": bootstrap_scan_counts,
    "bootstrap_gather": bootstrap_gather,
    "bootstrap_poisson": bootstrap_poisson,
    "bootstrap_udf": bootstrap_udf,
    "bootstrap_median_error": bootstrap_median_error,
    "bootstrap_median_error_by_model": bootstrap_median_error_by_model,
    "roc_auc": roc_auc,
    "bootstrap_auc": bootstrap_auc,
    "bootstrap_auc_ci": bootstrap_auc_ci,
    "indexed_rows": indexed_rows,
    "results_clean": results,
    "results_tagged": results_tagged,
    "results_union": results_union,
    "results_rewritten": results_rewritten,
    "timing_vector": timing_vector,
    "result_paths": result_paths,
    "results_count": lambda spark, folder: speedup.count_by(results(spark, folder)),
    "results_count_ordered": results_count_ordered,
    "results_count_merged": results_count_merged,
    "num_workers_distinct": lambda spark, folder: speedup.worker_counts(results(spark, folder)),
    "num_workers_first": num_workers_first,
    "baseline": lambda spark, folder: speedup.baseline(results(spark, folder)),
    "speed_ups": speed_ups,
    "speed_ups_no_platform": speed_ups_no_platform,
    "speed_ups_with_workers": speed_ups_with_workers,
    "mean_speed_up": mean_speed_up,
    "mean_speed_up_merged": mean_speed_up_merged,
    "mean_speed_up_backend": mean_speed_up_backend,
    "best_configuration": best_configuration,
    "best_speed_up": lambda spark, folder: speedup.best_speed_up(results(spark, folder)),
    "best_speed_up_no_platform": best_speed_up_no_platform,
    "files_stacked": files_stacked,
    "duplicate_run_keys": duplicate_run_keys,
    "elapsed_trend": elapsed_trend,
    "elapsed_trend_no_platform": elapsed_trend_no_platform,
    "elapsed_trend_merged": elapsed_trend_merged,
    "monitor_clean": monitor_clean,
    "monitor_saved": monitor_saved,
    "monitor_main_pid": monitor_main_pid,
    "monitor_main_pid_by_file": monitor_main_pid_by_file,
    "monitor_count": lambda spark, folder: speedup.count_by(samples(spark, folder)),
    "monitor_rel_time": monitor_rel_time,
    "cpu_range": lambda spark, folder: monitor.cpu_range(samples(spark, folder)),
    "cpu_outliers": lambda spark, folder: monitor.unusual_processes(samples(spark, folder)),
    "cpu_range_merged": cpu_range_merged,
    "cpu_outliers_merged": cpu_outliers_merged,
    "worker_panel": worker_panel,
    "panel_labels": lambda spark, folder: monitor.panel_labels(samples(spark, folder)),
    "labels_of_panel": labels_of_panel,
    "single_run": single_run,
    "busy_workers": busy_workers,
    "busy_at_moments": busy_at_moments,
    "busy_peak": busy_peak,
    "idle_share": idle_share,
    "idle_periods": idle_periods,
    "package_names": package_names,
}
