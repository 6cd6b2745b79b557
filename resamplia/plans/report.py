"""All tables of a benchmark report from its timing rows and CPU samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from resamplia.operators.checks import duplicate_keys
from resamplia.plans import monitor, speedup


def benchmark_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Counts, speed-ups, means, best figure, trend, and runs that are recorded twice.

    Each table reads `results` anew: pass a stored table if it is costly to make.
    """
    return {
        "results_count": speedup.count_by(results),
        "num_workers": speedup.worker_counts(results),
        "speed_ups": speedup.speed_ups_with_workers(results),
        "mean_speed_up": speedup.mean_speed_up(results),
        "best_speed_up": speedup.best_speed_up(results),
        "elapsed_trend": speedup.elapsed_trend(results),
        "duplicate_runs": duplicate_keys(speedup.baseline(results), speedup.RUN_KEYS),
    }


def utilization_tables(
    samples: DataFrame, panels: Sequence[tuple[str, str, Sequence[str] | None]] = ()
) -> dict[str, DataFrame]:
    """Counts, unusual processes, labels, and one table of series and one of labels per (framework, backend,
    platforms) panel. A panel without samples gives empty tables. Each table reads `samples` anew."""
    tables = {
        "monitor_count": speedup.count_by(samples),
        "unusual_processes": monitor.unusual_processes(samples),
        "panel_labels": monitor.panel_labels(samples),
    }
    for framework, backend, platforms in panels:
        name = " ".join(["panel", framework, backend, *(platforms or [])])
        tables[name] = monitor.worker_panel(samples, framework, backend, platforms)
        tables[f"{name} labels"] = monitor.labels_of_panel(samples, framework, backend, platforms)
    return tables
