"""Bootstrap draws as relations that are generated inside the plan and never stored.

Every random number is xxhash64 of (seed, counters). It depends on nothing but those values,
so a retried task, another partition count or another cluster gives the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext
from math import ceil, floor, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The Poisson pass of the scan method aims at least this many standard deviations below n
# draws; it exceeds n with probability below 1e-15.
MARGIN = 8.0

# The five primes of XXH64, and the seed that xxhash64 starts from.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
START = 42

# Last counter of the added draws, which keeps their random numbers apart from the weights.
ADDED = 1


def _hash63(seed: int, *counters: str | int) -> Column:
    """Uniform integer in [0, 2^63); narrower integers count as 64 bits, as in `PoissonWeights`."""
    values = [(F.lit(v) if isinstance(v, int) else F.col(v)).cast("bigint") for v in (seed, *counters)]
    return F.shiftrightunsigned(F.xxhash64(*values), 1)


def _random_row(seed: int, size: int, *counters: str | int) -> Column:
    """Uniform row index in [0, size)."""
    row = _hash63(seed, *counters) % F.lit(size).cast("bigint")
    # `%` counts as nullable. Without coalesce, a join tests the index for null and hashes twice.
    return F.coalesce(row, F.lit(0).cast("bigint")).alias("row_ix")


def task_count(spark: SparkSession, work: int, per_task: int) -> int:
    """Tasks for `work` units: all cores when there is enough to do, and bounded task length."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(4 * cores, ceil(work / 200_000)), min(100_000, ceil(work / per_task)))


def draws(spark: SparkSession, size: int, times: int, seed: int, first: int = 1) -> DataFrame:
    """(replicate, row_ix): `size` draws with replacement from 0..size-1 for every replicate
    first..times. Replicates before `first` are not generated."""
    if size < 1 or times < first or first < 1:
        raise ValueError("need at least one row and one replicate")
    if size * times >= 2**63:
        raise ValueError("more than 2^63 draws")
    start, end = (first - 1) * size, times * size
    ids = spark.range(start, end, 1, task_count(spark, end - start, 4_000_000))
    return ids.select(
        (F.expr(f"id div {size}") + 1).alias("replicate"),
        _random_row(seed, size, "id"),
    )


def poisson_thresholds(rate: float) -> list[int]:
    """P(X <= k) * 2^63 for k = 0, 1, ..., up to the last value below 2^63."""
    limits = []
    with localcontext() as context:
        context.prec = 50
        exact = Decimal(rate)
        term = (-exact).exp()
        total = term
        while int(total * 2**63) < 2**63 and (not limits or int(total * 2**63) > limits[-1]):
            limits.append(int(total * 2**63))
            term = term * exact / len(limits)
            total += term
    return limits


def with_poisson_weight(df: DataFrame, rate: float, first: int, last: int, seed: int) -> DataFrame:
    """Every row once per replicate in which its Poisson(rate) weight `w` is positive.

    Weights depend on (seed, replicate, row_ix) alone: no join, no shuffle, one pass.
    """
    limits = poisson_thresholds(rate)
    w = F.lit(len(limits))
    for k in range(len(limits) - 1, 0, -1):
        w = F.when(F.col("_u") < limits[k], k).otherwise(w)
    numbers = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
    drawn = df.withColumn("replicate", F.explode(numbers)).withColumn("_u", _hash63(seed, "replicate", "row_ix"))
    return drawn.where(F.col("_u") >= limits[0]).withColumn("w", w.cast("bigint")).drop("_u")


class PoissonWeights:
    """The weights of `with_poisson_weight` for the rows low..high-1, or the rows given, in numpy, one replicate at a time: for
    functions that run in Python workers anyway, so that no drawn row has to be sent to them."""

    # Rows that are hashed at a time (they stay in the cache of a core), and weights that are told apart by comparing all rows.
    BLOCK, COMMON = 1 << 13, 4

    def __init__(self, rate: float, seed: int, low: int, high: int, rows: np.ndarray | None = None):
        numbers = np.arange(low, high) if rows is None else rows
        self.limits, self.n = np.array(poisson_thresholds(rate), np.int64), len(numbers)
        self.start = self._hash(np.array([seed]).astype(np.uint64), np.array([START], np.uint64))
        self.rows = self._spread(numbers.astype(np.uint64))

    @staticmethod
    def _turn(x: np.ndarray, bits: int) -> np.ndarray:
        return x << np.uint64(bits) | x >> np.uint64(64 - bits)

    def _spread(self, value: np.ndarray) -> np.ndarray:
        return self._turn(value * np.uint64(PRIMES[1]), 31) * np.uint64(PRIMES[0])

    def _finish(self, spread: np.ndarray, before: np.ndarray) -> np.ndarray:
        h = (before + np.uint64(PRIMES[4]) + np.uint64(8)) ^ spread
        rest = h >> np.uint64(37)
        h <<= np.uint64(27)
        h |= rest
        h *= np.uint64(PRIMES[0])
        h += np.uint64(PRIMES[3])
        for bits, prime in ((33, PRIMES[1]), (29, PRIMES[2])):
            np.right_shift(h, np.uint64(bits), out=rest)
            h ^= rest
            h *= np.uint64(prime)
        np.right_shift(h, np.uint64(32), out=rest)
        h ^= rest
        return h

    def _hash(self, value: np.ndarray, before: np.ndarray) -> np.ndarray:
        """One 64-bit integer hashed on top of a hash."""
        return self._finish(self._spread(value), before)

    def of(self, replicate: int) -> np.ndarray:
        return self.matrix(replicate, replicate + 1)[0]

    def matrix(self, begin: int, end: int) -> np.ndarray:
        """Weights of the replicates begin..end-1, a row for each; few rows are hashed for several replicates at a time."""
        weight = np.zeros((end - begin, self.n), np.int64)
        if not len(self.limits) or not self.n:
            return weight
        before = self._hash(np.arange(begin, end).astype(np.uint64), self.start)[:, None]
        step = max(1, self.BLOCK // self.n)
        for top in range(0, end - begin, step):
            for low in range(0, self.n, self.BLOCK):
                u = self._finish(self.rows[low : low + self.BLOCK], before[top : top + step])
                u >>= np.uint64(1)
                u = u.view(np.int64)
                some = (u >= self.limits[0]).view(np.int8)
                for limit in self.limits[1 : self.COMMON]:
                    some += (u >= limit).view(np.int8)
                part = weight[top : top + step, low : low + self.BLOCK]
                part[...] = some
                if len(self.limits) > self.COMMON:
                    rare = np.nonzero(u >= self.limits[self.COMMON])
                    part[rare] = np.searchsorted(self.limits, u[rare], "right")
        return weight


def scan_rate(size: int) -> float:
    """Largest 1 - 2^-k that leaves MARGIN * sqrt(size) draws to be added; 0 for small tables."""
    return 1.0 - 0.5 ** max(0, floor(log2(sqrt(size) / MARGIN)))


def _poisson_totals(rate: float, size: int, seed: int, first: int, times: int, pieces: int, groups: int):
    """Total weights of a piece of the rows in a group of the replicates; ids number the pairs of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                piece, group = divmod(number, groups)
                sets = np.arange(first + group * (times - first + 1) // groups, first + (group + 1) * (times - first + 1) // groups)
                total = np.zeros(len(sets), np.int64)
                low, high = piece * size // pieces, (piece + 1) * size // pieces
                for at in range(low, high, PoissonWeights.BLOCK):
                    weights = PoissonWeights(rate, seed, at, min(at + PoissonWeights.BLOCK, high))
                    total += [int(weights.of(b).sum()) for b in sets.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(total)], ["replicate", "drawn"])

    return run


def scan_totals(spark: SparkSession, size: int, times: int, seed: int, first: int = 1) -> DataFrame:
    """(replicate, missing): draws a replicate still needs after its Poisson pass.

    Row indexes are dense, so this pass reads no table.
    """
    replicates = spark.range(first, times + 1, 1, 1).select(F.col("id").alias("replicate"))
    rate, sets = scan_rate(size), times - first + 1
    if rate == 0.0:
        return replicates.select("replicate", F.lit(size).cast("bigint").alias("missing"))
    tasks = task_count(spark, size * sets, 200_000_000)
    pieces = min(tasks, ceil(size / PoissonWeights.BLOCK))
    groups = min(sets, ceil(tasks / pieces))
    units = spark.range(0, pieces * groups, 1, pieces * groups)
    weighted = units.mapInArrow(_poisson_totals(rate, size, seed, first, times, pieces, groups), "replicate long, drawn long")
    totals = weighted.groupBy("replicate").agg(F.sum("drawn").alias("drawn"))
    missing = F.lit(size) - F.coalesce(F.col("drawn"), F.lit(0))
    return replicates.join(totals, "replicate", "left").select(
        "replicate",
        F.when(missing >= 0, missing)
        .otherwise(F.raise_error(F.lit("a replicate drew too many rows; use another seed")))
        .alias("missing"),
    )


def scan_top_up(spark: SparkSession, size: int, times: int, seed: int, first: int = 1) -> DataFrame:
    """(replicate, row_ix): the single draws that complete every replicate of the scan method."""
    step = 4096
    expected = int((times - first + 1) * (1.0 - scan_rate(size)) * size)
    chunks = scan_totals(spark, size, times, seed, first).where("missing > 0").select(
        "replicate",
        "missing",
        F.explode(F.sequence(F.lit(0), F.expr(f"(missing - 1) div {step}"))).alias("chunk"),
    )
    # Spread the chunks first: one task must not expand all replicates.
    spread = chunks.repartition(task_count(spark, expected, 4_000_000), "replicate", "chunk")
    last = F.least(F.col("missing"), (F.col("chunk") + 1) * step)
    return spread.select(
        "replicate", F.explode(F.sequence(F.col("chunk") * step + 1, last)).alias("draw")
    ).select("replicate", _random_row(seed, size, "replicate", "draw", ADDED))


# Parts in which a table is broadcast at most: each draw is generated once for every part.
PARTS = 16


def gather(pairs: DataFrame, size: int, times: int, seed: int, first: int = 1, parts: int = 1) -> DataFrame:
    """Analysis sets by looking up drawn rows in `pairs`, which is broadcast in `parts` ranges of row_ix that the caller has counted
    to be small; with parts=0 draws are joined by a shuffle."""
    drawn = draws(pairs.sparkSession, size, times, seed, first)
    if parts < 2:
        return drawn.join(F.broadcast(pairs) if parts else pairs, "row_ix").select("replicate", *pairs.columns)
    part, found = F.expr(f"row_ix div {ceil(size / parts)}"), None
    for k in range(parts):
        some = drawn.where(part == k).join(F.broadcast(pairs.where(part == k)), "row_ix").select("replicate", *pairs.columns)
        found = some if found is None else found.unionByName(some)
    return found


# An added draw as one negative integer: the place of its replicate, and how often the replicate draws the row so.
SHIFT = 32


def scan(pairs: DataFrame, size: int, times: int, seed: int, first: int = 1, rows: int | None = None, copy: str | None = None) -> DataFrame:
    """Analysis sets of exactly `size` draws without moving size * times draws.

    Poisson(rate) weights with a rate a little below 1 are multinomial given their total, so
    adding the missing draws one by one gives exactly `size` draws with replacement. Rows move once, with the replicates in which they are
    added draws (8 to 16 times sqrt(size) per replicate); all draws of a row are made in one task, and the result is partitioned by
    row_ix. `rows` is the number of rows of `pairs`, if it is not `size`; `copy` names a column that numbers the copies of a row in a set.
    """
    spark, sets = pairs.sparkSession, times - first + 1
    tasks = task_count(spark, (rows or size) * sets, 100_000_000)
    spread = pairs.where(F.col("row_ix").isNotNull()).repartition(tasks, "row_ix")
    added = scan_top_up(spark, size, times, seed, first).repartition(tasks, "row_ix").groupBy("row_ix", "replicate").agg(F.count("*").alias("_m"))
    packed = -(F.shiftleft(F.col("replicate") - (first - 1), SHIFT) + F.col("_m"))
    extra = added.groupBy("row_ix").agg(F.collect_list(packed).alias("_extra"))
    # Uniform keys, one row each: hash them, sort nothing.
    moved = spread.join(extra.hint("shuffle_hash"), "row_ix", "left")
    rate = scan_rate(size)
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(sets).cast("bigint")) if rate else F.array().cast("array<bigint>")
    entry = F.explode(F.concat(numbers, F.coalesce("_extra", F.array().cast("array<bigint>"))))
    replicate = F.when(F.col("_entry") > 0, F.col("_entry")).otherwise(F.shiftright(-F.col("_entry"), SHIFT)) + F.lit(first - 1).cast("bigint")
    drawn = moved.select(*pairs.columns, entry.alias("_entry")).withColumn("replicate", replicate)
    limits = poisson_thresholds(rate)
    drawn = drawn.withColumn("_u", _hash63(seed, "replicate", "row_ix"))
    if limits:
        drawn = drawn.where((F.col("_u") >= limits[0]) | (F.col("_entry") < 0))
    w = F.lit(len(limits))
    for k in range(len(limits) - 1, -1, -1):
        w = F.when(F.col("_u") < limits[k], k).otherwise(w)
    drawn = drawn.withColumn("_w", w)
    # The copies of a weight are looked up; those of added draws follow them.
    copies = F.array(*[F.array(*[F.lit(c) for c in range(1, k + 1)]) for k in range(1, len(limits) + 1)]) if limits else F.array().cast("array<array<int>>")
    later = F.sequence(F.col("_w") + 1, F.col("_w") + (-F.col("_entry")).bitwiseAND(F.lit((1 << SHIFT) - 1).cast("bigint")).cast("int"))
    number = F.explode(F.when(F.col("_entry") > 0, F.get(copies, F.col("_w") - 1)).otherwise(later))
    return drawn.select("replicate", *pairs.columns, number.alias(copy or "_copy")).select("replicate", *pairs.columns, *([copy] if copy else []))
