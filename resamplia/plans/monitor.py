"""Analysis of CPU samples: relative time, outlier processes, worker series, idle share.

A sample has time, pid, pct_cpu, main_pid, parallel, run, framework, backend, platform.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resamplia.functions.scalars import (
    epoch_seconds,
    minutes_seconds,
    panel_title,
    seconds_between,
    time_axis_label,
    worker_label,
)
from resamplia.operators.joins import inner_join_nulls_match, small_side
from resamplia.operators.ordered import dense_codes
from resamplia.operators.sweep import RANGE, ranged, with_previous, with_running_sum
from resamplia.sources.files import SCENARIO

# Percent CPU limits outside which a process is listed as unusual.
UNUSUAL_ABOVE, UNUSUAL_BELOW = 250.0, 1.0


def relative_time(monitor: DataFrame, keys: Sequence[str] = ("run", *SCENARIO)) -> DataFrame:
    """Add `rel_time`, 0 at the first and 1 at the last sample of a run; null if they coincide.

    Apply it before samples without CPU value are dropped. Limits are aggregated and joined
    back: a long run is not gathered into one window task, and samples are not shuffled.
    """
    limits = monitor.groupBy(*keys).agg(
        F.min(epoch_seconds(F.col("time"))).alias("_low"),
        F.max(epoch_seconds(F.col("time"))).alias("_high"),
    )
    share = F.try_divide(epoch_seconds(F.col("time")) - F.col("_low"), F.col("_high") - F.col("_low"))
    joined = inner_join_nulls_match(monitor, small_side(limits), keys)
    return joined.withColumn("rel_time", share).drop("_low", "_high")


def cpu_range(monitor: DataFrame) -> DataFrame:
    return monitor.groupBy("run", "pid", "framework", "backend").agg(
        F.max("pct_cpu").alias("max_cpu"), F.min("pct_cpu").alias("min_cpu")
    )


def unusual_processes(monitor: DataFrame) -> DataFrame:
    """Processes that once used very much CPU, or never any."""
    limits = (F.col("max_cpu") > UNUSUAL_ABOVE) | (F.col("max_cpu") < UNUSUAL_BELOW)
    return cpu_range(monitor).where(limits).drop("max_cpu", "min_cpu")


def worker_samples(monitor: DataFrame) -> DataFrame:
    """Samples of worker processes in parallel runs."""
    return monitor.where(F.col("parallel") & (F.col("pid") != F.col("main_pid")))


def single_run(monitor: DataFrame, framework: str, run: int) -> DataFrame:
    return worker_samples(monitor).where((F.col("framework") == framework) & (F.col("run") == run))


def first_run(df: DataFrame) -> DataFrame:
    """All rows of the smallest run number."""
    return df.where(F.col("run") == df.agg(F.min("run")).scalar())


def panel_samples(
    monitor: DataFrame, framework: str, backend: str, platforms: Sequence[str] | None = None
) -> DataFrame:
    chosen = worker_samples(monitor).where(
        (F.col("framework") == framework) & (F.col("backend") == backend)
    )
    if platforms is not None:
        chosen = chosen.where(F.col("platform").isin(list(platforms)))
    return first_run(chosen)


def worker_panel(
    monitor: DataFrame, framework: str, backend: str, platforms: Sequence[str] | None = None
) -> DataFrame:
    """Series of all workers of one panel, labelled and in time order.

    Workers are numbered in pid order. The sort is a range sort on (worker, time), so one long
    series is spread over several tasks.
    """
    panel = panel_samples(monitor, framework, backend, platforms)
    codes = small_side(dense_codes(panel, "pid"))
    width = codes.agg(F.max(F.length(F.col("code").cast("string")))).scalar()
    return (
        panel.join(codes, "pid")
        .select(*panel.columns, "code")
        .withColumn("worker", worker_label(F.col("code"), width))
        .withColumn("min_sec", minutes_seconds(F.col("time")))
        .orderBy("code", "time")
    )


def panel_labels(monitor: DataFrame) -> DataFrame:
    """For every scenario, from its first run: total seconds, title and axis text."""
    runs = worker_samples(monitor).groupBy(*SCENARIO, "run").agg(
        F.min("time").alias("start"), F.max("time").alias("end")
    )
    first = runs.groupBy(*SCENARIO).agg(
        F.min("run").alias("run"), F.min_by(F.struct("start", "end"), "run").alias("span")
    )
    return _labels(first.select(*SCENARIO, "run", "span.*"))


def labels_of_panel(
    monitor: DataFrame, framework: str, backend: str, platforms: Sequence[str] | None = None
) -> DataFrame:
    """The same for the series that `worker_panel` gives for these platforms: one row per platform asked for, all with the
    run and the time of the whole panel. No row if the panel is empty."""
    panel = panel_samples(monitor, framework, backend, platforms)
    names = F.collect_set("platform") if platforms is None else F.array(*map(F.lit, platforms))
    span = panel.agg(F.min("run").alias("run"), F.min("time").alias("start"), F.max("time").alias("end"), names.alias("names"))
    named = span.where("run is not null").withColumn("platform", F.explode("names"))
    scenario = named.withColumns({"framework": F.lit(framework), "backend": F.lit(backend)})
    return _labels(scenario.select(*SCENARIO, "run", "start", "end"))


def _labels(spans: DataFrame) -> DataFrame:
    seconds = seconds_between(F.col("end"), F.col("start"))
    return spans.select(
        *SCENARIO,
        "run",
        F.ceil(seconds).cast("bigint").alias("total_seconds"),
        panel_title(F.col("framework"), F.col("backend"), F.col("platform")).alias("title"),
        time_axis_label(seconds).alias("x_label"),
    )


# A process id means something within one run only.
WORKER = ("run", *SCENARIO, "pid")


def busy_workers(monitor: DataFrame, width: str, busy_above: float, by: Sequence[str | Column] = ()) -> DataFrame:
    """Number of distinct workers above a CPU limit in each time window; main processes do not count."""
    busy = F.when(F.col("pct_cpu") > busy_above, F.struct(*WORKER))
    slot = F.window("time", width)
    return (
        worker_samples(monitor).groupBy(slot.alias("slot"), *by)
        .agg(F.count_distinct(busy).alias("busy"), F.count("*").alias("samples"))
        .select(F.col("slot.start").alias("start"), *by, "busy", "samples")
    )


def idle_share(monitor: DataFrame, idle_below: float, by: Sequence[str] = WORKER) -> DataFrame:
    """Share of samples in which a worker was idle; main processes do not count."""
    idle = F.avg((F.col("pct_cpu") < idle_below).cast("int"))
    return worker_samples(monitor).groupBy(*by).agg(F.count("*").alias("samples"), idle.alias("idle_share"))


# A run is one scenario's; its workers are told apart by process id.
RUN = ("run", *SCENARIO)


def _states(monitor: DataFrame, name: str, holds: Column) -> DataFrame:
    """Of every worker and sampling time (`moment`, microseconds): does `holds` in a sample of then, 1 or 0? Samples without
    a value or a time say nothing."""
    samples = worker_samples(monitor).where(F.col("pct_cpu").isNotNull() & ~F.isnan("pct_cpu") & F.col("time").isNotNull())
    return samples.groupBy(*WORKER, F.unix_micros("time").alias("moment")).agg(
        F.max(holds.cast("int")).alias(name), F.count("*").alias("samples")
    )


def busy_at_moments(monitor: DataFrame, busy_above: float, by: Sequence[str] = RUN) -> DataFrame:
    """The number of busy workers from each moment on at which it changes: by, moment (microseconds), busy.

    A worker is busy from a sample above the limit until its next sample that is not, or until its last sample. Main processes do
    not count. Intervals are never formed: their ends are changes of +1 and -1, which are summed per moment and then along time, so all
    that happens at one moment counts together.
    """
    rows = ranged(_states(monitor, "on", F.col("pct_cpu") > busy_above).drop("samples"), "moment")
    last = small_side(rows.groupBy(*WORKER).agg(F.max("moment").alias("_end")))
    known = inner_join_nulls_match(with_previous(rows, WORKER, "moment", "on", "_before"), last, WORKER)
    now = F.when(F.col("moment") < F.col("_end"), F.col("on")).otherwise(0)
    changes = known.select(*by, "moment", RANGE, (now - F.coalesce("_before", F.lit(0))).alias("change")).where("change <> 0")
    moments = changes.groupBy(*by, "moment", RANGE).agg(F.sum("change").alias("change")).where("change <> 0")
    return with_running_sum(moments, by, "moment", "change", "busy").select(*by, "moment", "busy")


def busy_peak(monitor: DataFrame, busy_above: float, by: Sequence[str] = RUN) -> DataFrame:
    """The largest number of workers busy at once, when that was first reached, and the mean number over the time between the first and
    the last change."""
    moments = ranged(busy_at_moments(monitor, busy_above, by), "moment")
    # The next moment of a group is the one before on the reversed axis.
    back = ranged(moments.drop(RANGE).withColumn("_back", -F.col("moment")), "_back")
    spans = with_previous(back, by, "_back", "moment", "_next").withColumn("_length", F.coalesce(F.col("_next") - F.col("moment"), F.lit(0)))
    return spans.groupBy(*by).agg(
        F.max("busy").alias("peak"), F.min_by("moment", F.struct(-F.col("busy"), F.col("moment"))).alias("moment"),
        F.try_divide(F.sum(F.col("busy") * F.col("_length")), F.sum("_length")).alias("mean_busy"),
    )


def idle_periods(monitor: DataFrame, idle_below: float) -> DataFrame:
    """Longest stretches of samples in which a worker was idle: worker, start_at and end_at (microseconds of the first and last idle
    sample), samples. Samples of one worker and time are idle if all are.

    Periods are numbered by the running number of their beginnings, so one that lasts over many ranges is counted by partial
    sums like any other group.
    """
    busy = _states(monitor, "_busy", F.col("pct_cpu") >= idle_below)
    rows = with_previous(ranged(busy, "moment"), WORKER, "moment", "_busy", "_before")
    begins = (F.col("_busy") == 0) & (F.coalesce("_before", F.lit(1)) == 1)
    numbered = with_running_sum(rows.withColumn("_begins", begins.cast("int")), WORKER, "moment", "_begins", "_period")
    return numbered.where("_busy = 0").groupBy(*WORKER, "_period").agg(
        F.min("moment").alias("start_at"), F.max("moment").alias("end_at"), F.sum("samples").alias("samples")
    ).drop("_period")
