"""Percentile intervals of very many replicates, or of any column, from sketches that merge."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resamplia.functions.sketch import Sketch, SketchMerge
from resamplia.plans.set_metrics import FAN, merge_states

# Numbers that a buffer of a sketch holds.
SIZE = 4096


def _starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where the runs of equal keys begin; null equals null."""
    changes = np.zeros(batch.num_rows, bool)
    changes[:1] = True
    for key in keys:
        column = batch.column(key)
        same = pc.equal(column[1:], column[:-1]) if batch.num_rows > 1 else pa.array([], pa.bool_())
        both_null = pc.and_(column[1:].is_null(), column[:-1].is_null())
        changes[1:] |= ~np.asarray(pc.or_(pc.fill_null(same, False), both_null).to_numpy(zero_copy_only=False), bool)
    return np.flatnonzero(changes).tolist()


def _sketch(keys: list[str], value: str, size: int):
    """A sketch of each run of equal keys in a batch; a key has one for every batch that it occurs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = _starts(batch, keys)
            values = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            states = [pickle.dumps(Sketch(size).add(values[a:b])) for a, b in zip(begin, [*begin[1:], batch.num_rows], strict=True)]
            first = batch.select([*keys, "_piece"]).take(pa.array(begin))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(states, pa.binary())], [*keys, "_piece", "state"])

    return run


def _read(keys: list[str], quantiles: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column("state"):
                sketch = pickle.loads(blob.as_py())
                rows.append(([dict(zip(("low", "high"), sketch.bounds(q) or (None, None), strict=True)) for q in quantiles], sketch.n, sketch.error))
            bounds, n, error = zip(*rows, strict=True) if rows else ((), (), ())
            kind = pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, pa.array(bounds, kind), pa.array(n, pa.int64()), pa.array(error, pa.int64())], [*keys, "bounds", "n", "error"])

    return run


def quantile_bounds(df: DataFrame, value: str, quantiles: Sequence[float], keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """For each key: `bounds` (for each quantile the numbers low and high that enclose it), n (values that are neither null nor NaN) and
    `error`: by how many ranks, at most, low or high may be off their place.

    Tasks summarize what they read; summaries are merged level by level. No task holds the values of a key, however many there are.
    """
    keys = list(keys)
    parts = FAN * FAN
    rows = df.select(*keys, F.col(value).cast("double").alias(value)).withColumn("_piece", F.pmod(F.spark_partition_id().cast("bigint"), F.lit(parts)))
    fields = [df.schema[c] for c in keys]
    schema = T.StructType([*fields, T.StructField("_piece", T.LongType()), T.StructField("state", T.BinaryType())])
    # Rows of a key lie together within a partition, so that a batch has few sketches.
    own = rows.sortWithinPartitions(*keys) if keys else rows
    states = own.mapInArrow(_sketch(keys, value, size), schema)
    merged = merge_states(states, SketchMerge(), keys, parts)
    pair = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    out = T.StructType([*fields, T.StructField("bounds", T.ArrayType(pair)), T.StructField("n", T.LongType()), T.StructField("error", T.LongType())])
    return merged.mapInArrow(_read(keys, list(quantiles)), out)


def percentile_bounds(scores: DataFrame, keys: Sequence[str] = ("metric",), level: float = 0.95, size: int = SIZE) -> DataFrame:
    """As `percentile_ci` for any number of replicates: lower and upper as pairs (low, high) that enclose the exact limits, replicates
    with a value, and rank_error, the share of the replicates by which a limit may be off its rank."""
    tail = round((1.0 - level) / 2.0, 12)
    found = quantile_bounds(scores, "estimate", [tail, round(1.0 - tail, 12)], keys, size)
    share = F.try_divide(F.col("error").cast("double"), F.col("n"))
    return found.select(*keys, F.col("bounds")[0].alias("lower"), F.col("bounds")[1].alias("upper"), F.col("n").alias("replicates"), share.alias("rank_error"))
