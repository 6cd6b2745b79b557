"""Recodes, time arithmetic and label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names written by the measuring scripts, and the names used in reports.
BACKEND_NAMES = {"foreach": "multisession"}
PLATFORM_NAMES = {"source": "unix", "mac.binary.big-sur-arm64": "macOS"}


def recode(column: Column, names: dict[str, str]) -> Column:
    """Replace listed values, keep the others; null stays null."""
    result = column
    for old, new in names.items():
        result = F.when(column == old, new).otherwise(result)
    return result


def recode_backend(column: str = "backend") -> Column:
    return recode(F.col(column), BACKEND_NAMES).alias(column)


def recode_platform(column: str = "platform") -> Column:
    return recode(F.col(column), PLATFORM_NAMES).alias(column)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def minutes_seconds(ts: Column) -> Column:
    return F.date_format(ts, "mm:ss")


def right_justified(number: Column, width: Column) -> Column:
    """Digits padded on the left with blanks to `width`."""
    text = number.cast("string")
    return F.concat(F.repeat(F.lit(" "), (width - F.length(text)).cast("int")), text)


# The texts of labels, titles and axes, as reports show them.
WORKER, VIA, AXIS = "worker process", " via ", "Time (min:sec)\ntotal time: "


def worker_label(code: Column, width: Column) -> Column:
    return F.concat_ws(" ", F.lit(WORKER), right_justified(code, width))


def panel_title(framework: Column, backend: Column, platform: Column) -> Column:
    return F.concat(framework, F.lit(VIA), backend, F.lit(" ("), platform, F.lit(")"))


def time_axis_label(seconds: Column) -> Column:
    """Axis text with the total time in whole seconds."""
    whole = F.ceil(seconds).cast("bigint").cast("string")
    return F.concat(F.lit(AXIS), whole, F.lit("s"))


def without(column: Column, pattern: str) -> Column:
    """Remove every match of `pattern`."""
    return F.regexp_replace(column, pattern, "")


def file_path(*parts: str | Column) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])
