"""Timing and monitor tables: readers, writers and the tags their rows carry."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resamplia.functions.scalars import recode_backend, recode_platform
from resamplia.operators.joins import inner_join_nulls_match, small_side

SCENARIO = ("framework", "backend", "platform")

TAG_TYPES = {
    "parallel": T.BooleanType(),
    "run": T.LongType(),
    "num_workers": T.IntegerType(),
    "framework": T.StringType(),
    "backend": T.StringType(),
    "platform": T.StringType(),
}

# Names of the five measured times, in seconds.
TIMES = ("user_self", "sys_self", "elapsed", "user_child", "sys_child")

RESULTS_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in TIMES]
    + [T.StructField(name, kind) for name, kind in TAG_TYPES.items()]
)

MONITOR_SCHEMA = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("pid", T.LongType()),
        T.StructField("pct_cpu", T.DoubleType()),
        *[T.StructField(name, kind) for name, kind in TAG_TYPES.items()],
        T.StructField("rel_time", T.DoubleType()),
        T.StructField("main_pid", T.LongType()),
    ]
)


def with_tags(df: DataFrame, **tags: object) -> DataFrame:
    """Add constant columns such as run, framework or platform."""
    return df.withColumns(
        {
            name: F.lit(value).cast(TAG_TYPES[name]) if name in TAG_TYPES else F.lit(value)
            for name, value in tags.items()
        }
    )


def timing_row(spark: SparkSession, timing: Mapping[str, float], **tags: object) -> DataFrame:
    """One-row table from named times, with tags."""
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in timing])
    row = tuple(float(seconds) for seconds in timing.values())
    return with_tags(spark.createDataFrame([row], schema), **tags)


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column that a table lacks is null in its rows."""
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked


def run_suffix(framework: str, backend: str, run: int) -> str:
    """File-name part of one scenario run; a slash cannot be part of a file name."""
    return "-".join([framework, backend, str(run)]).replace("/", "_").replace("%", "")


def save_results(df: DataFrame, root: str, suffix: str) -> str:
    path = f"{root}/res-{suffix}"
    df.write.parquet(path)
    return path


def save_monitor(df: DataFrame, main_pid: int, root: str, suffix: str) -> str:
    """The one process id that belongs to the whole table becomes a column."""
    path = f"{root}/monitor-{suffix}"
    df.withColumn("main_pid", F.lit(main_pid).cast("bigint")).write.parquet(path)
    return path


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("framework", "backend")) -> None:
    """All runs as one table. Rows are clustered by run, so that Parquet statistics prune a
    filter on run without one folder per run. Rebalancing splits a run that is too large for
    one task and merges small ones."""
    placed = df.hint("rebalance", *partition_by, "run")
    placed.sortWithinPartitions(*partition_by, "run").write.partitionBy(*partition_by).parquet(path)


def checked_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df`, which is an error when it is computed if two rows have the same `keys` (null equals null). Keys are counted beside the rows: none
    of these is moved."""
    message = F.concat(F.lit("repeated key "), F.to_json(F.struct(*[F.col(k) for k in keys])))
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    found = repeated.select(F.raise_error(message).cast("string").alias("_error")).agg(F.max("_error"))
    return df.where(found.scalar().isNull())


RUN_FOLDERS = (*SCENARIO, "run")


def replace_runs(df: DataFrame, path: str, keys: Sequence[str] | None = None) -> None:
    """Write the runs in `df` to the table at `path`, each in place of what the table has of it; other runs stay untouched.

    To do it again changes nothing. Runs are folders that are put in place when all tasks are done, so after a failure the
    table is as it was. `keys` must not be repeated within `df`: an error, before anything is replaced. A null or empty
    framework, backend or platform is read back as null. Rebalancing lets several tasks write a run that is large for one.
    """
    rows = df if keys is None else checked_keys(df, keys)
    writer = rows.hint("rebalance", *RUN_FOLDERS).write.partitionBy(*RUN_FOLDERS)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that `replace_runs` writes. A filter on framework, backend, platform or run reads the folders it needs."""
    return spark.read.schema(schema).parquet(path)


def read_named(
    spark: SparkSession, root: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """One multi-file scan of everything under `root` whose name contains `name`.

    With a schema, columns missing from a file are null and nothing is inferred. Without one,
    the schemas of all files are merged. No match gives an empty table when a schema is given.
    """
    reader = spark.read.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.parquet(f"{root}/*{name}*")
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_results(spark: SparkSession, root: str, schema: T.StructType | None = RESULTS_SCHEMA) -> DataFrame:
    return clean_results(read_named(spark, root, "res-", schema))


def read_monitor(spark: SparkSession, root: str, schema: T.StructType | None = MONITOR_SCHEMA) -> DataFrame:
    return clean_monitor(read_named(spark, root, "monitor-", schema))


def clean_results(results: DataFrame) -> DataFrame:
    """Timing rows with the backend and platform names used in reports."""
    return results.withColumns({"backend": recode_backend(), "platform": recode_platform()})


def clean_monitor(monitor: DataFrame) -> DataFrame:
    """CPU samples that have a value, with the platform names used in reports."""
    known = F.col("pct_cpu").isNotNull() & ~F.isnan("pct_cpu")
    return monitor.where(known).withColumn("platform", recode_platform())


def attach_main_pid(
    monitor: DataFrame, main_pids: DataFrame, keys: Sequence[str] = ("run", *SCENARIO)
) -> DataFrame:
    """Add `main_pid` from a table with one row per run. A run without one keeps its samples, with null; two different
    main_pids for a run are an error."""
    several = F.raise_error(F.lit("a run has several main_pids"))
    one = main_pids.groupBy(*keys).agg(
        F.when(F.min("main_pid").eqNullSafe(F.max("main_pid")), F.min("main_pid")).otherwise(several).alias("main_pid")
    )
    return inner_join_nulls_match(monitor, small_side(one), keys, "left")


def _entry(root: str) -> Column:
    """The name, directly under `root`, of the file or folder that a row was read from."""
    place = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    # Paths come percent-encoded; a plus sign is one.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.split_part(F.substring_index(path, place, -1), F.lit("/"), F.lit(1))


def named(spark: SparkSession, root: str, names: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files under `root` whose name contains one of `names`, each once however many it contains, in one scan; `file` is the
    file's own name. A filter on `file` prunes files, not only rows. Without `schema` those of the files are merged."""
    reader = spark.read.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    pattern = "{" + ",".join(f"*{name}*" for name in names) + "}"
    try:
        found = reader.parquet(f"{root.rstrip('/')}/{pattern}")
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    return found.withColumn("file", _entry(root))


def stack_named(spark: SparkSession, root: str, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The given columns of all Parquet files under `root` whose name contains one of `names`, each file once, with the
    name of the file in `file`."""
    return named(spark, root, names).select("file", *columns)


def attach_by_file(rows: DataFrame, sidecars: DataFrame, value: str, rows_name: str = "monitor-", sidecar_name: str = "pid-") -> DataFrame:
    """Add `value` from the sidecar file of each row's file; both tables are as `named` gives them.

    A sidecar has the name of its file with `sidecar_name` in place of `rows_name`, and one value. Rows of a file without one stay, with null;
    a sidecar with several values, or a second one for a file, is an error. There is one row for each file: it is broadcast if few.
    """
    several = F.raise_error(F.concat(F.lit("several values in the sidecars of "), F.col("_key")))
    key = F.regexp_replace("file", F.lit("^" + re.escape(sidecar_name)), F.lit(""))
    one = sidecars.groupBy(key.alias("_key")).agg(F.min(value).alias(value), F.max(value).alias("_max"), F.count_distinct("file").alias("_files"))
    checked = one.select("_key", F.when(F.col(value).eqNullSafe(F.col("_max")) & (F.col("_files") == 1), F.col(value)).otherwise(several).alias(value))
    own = F.regexp_replace("file", F.lit("^" + re.escape(rows_name)), F.lit(""))
    return rows.join(small_side(checked), own == F.col("_key"), "left").drop("_key")


def save_sidecar(spark: SparkSession, main_pid: int, root: str, suffix: str) -> str:
    """The process id that belongs to the file `monitor-<suffix>`, in a file of its own."""
    path = f"{root}/pid-{suffix}"
    spark.createDataFrame([(main_pid,)], "main_pid long").write.mode("overwrite").parquet(path)
    return path


def read_monitor_files(spark: SparkSession, root: str, schema: T.StructType = MONITOR_SCHEMA) -> DataFrame:
    """Clean samples with `file` and the main_pid from the sidecar of their file."""
    own = T.StructType([f for f in schema.fields if f.name != "main_pid"])
    pids = named(spark, root, ["pid-"], T.StructType([T.StructField("main_pid", T.LongType())]))
    return attach_by_file(clean_monitor(named(spark, root, ["monitor-"], own)), pids, "main_pid")
