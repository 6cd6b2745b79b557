"""Ranks and running totals over all keys of a table without one global sort task."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resamplia.operators.joins import kept

# Keys are cut at RANGES - 1 percentiles, and again at percentiles of each range when a range would hold more
# than ROWS_PER_RANGE keys.
RANGES = 128
ROWS_PER_RANGE = 1_000_000


@dataclass(frozen=True)
class Ranges:
    """Cuts balance the work and nothing else: results are the same for any cuts."""

    cuts: tuple[float, ...]
    inner: tuple[tuple[float, ...], ...] = ()

    def number(self, key: str) -> Column:
        """Number of the range that holds `key`; it never falls when the key grows."""
        index = F.expr(self._bisect(key, self.cuts, 0))
        if not self.inner:
            return index
        # The cuts of a range are few, at most RANGES - 1.
        bounds = F.array(*[F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>") for cuts in self.inner])
        below = F.filter(F.get(bounds, index), lambda cut: cut < F.col(key).cast("double"))
        return index * RANGES + F.size(below)

    def with_cuts(self, cuts: Sequence[float]) -> Ranges:
        """The same ranges, cut at these places too."""
        new = tuple(sorted({*self.cuts, *cuts}))
        inner = tuple(self.inner[bisect_left(self.cuts, cut)] for cut in new) + self.inner[-1:] if self.inner else ()
        return Ranges(new, inner)

    def _bisect(self, key: str, cuts: Sequence[float], low: int) -> str:
        if not cuts:
            return str(low)
        middle = len(cuts) // 2
        cut = f"{cuts[middle]!r}D" if isinstance(cuts[middle], float) else str(cuts[middle])
        below = self._bisect(key, cuts[:middle], low)
        above = self._bisect(key, cuts[middle + 1 :], low + middle + 1)
        return f"CASE WHEN `{key}` <= {cut} THEN {below} ELSE {above} END"


def _finite(cuts: Sequence[float] | None) -> tuple[float, ...]:
    return tuple(sorted({cut for cut in cuts or () if isfinite(cut)}))


def find_ranges(keys: DataFrame, key: str) -> Ranges:
    """Ranges for a table of distinct keys. Only the cuts reach the driver, RANGES times RANGES at most."""

    def percentiles(parts: int) -> Column:
        return F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)

    count, cuts = keys.agg(F.count(key), percentiles(RANGES)).first()
    outer = Ranges(_finite(cuts))
    parts = min(RANGES, ceil(count / (RANGES * ROWS_PER_RANGE)))
    if parts < 2:
        return outer
    # Percentiles follow the keys, however uneven they are; infinite keys are keys like others.
    found = keys.where(F.col(key).isNotNull()).groupBy(outer.number(key).alias("_range")).agg(percentiles(parts).alias("cuts"))
    inner = {row["_range"]: _finite(row["cuts"]) for row in found.collect()}
    return Ranges(outer.cuts, tuple(inner.get(i, ()) for i in range(len(outer.cuts) + 1)))


def running_totals(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Add `<measure>_before`: the total of `measure` over all smaller keys.

    `df` has one row per numeric `key`, so no range can be filled by a single hot key. Each
    range is summed on its own and shifted by the totals of the ranges before it. `df` is used
    three times, so it is kept in memory or on disk; what is lost is computed again.
    """
    source = kept(df)
    ranged = source.withColumn("_range", find_ranges(source, key).number(key))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, a millionth of the keys: safe in one task, and safe to broadcast.
    offsets = ranged.groupBy("_range").agg(*[F.sum(m).alias(m) for m in measures]).select(
        "_range",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_offset") for m in measures],
    )
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_inside") for m in measures]
    )
    return totals.join(F.broadcast(offsets), "_range").select(
        *df.columns,
        *[(F.col(f"_{m}_offset") + F.col(f"_{m}_inside")).alias(f"{m}_before") for m in measures],
    )


def dense_codes(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, code): distinct keys numbered 1..k in key order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    ones = keys.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(ones, key, ["_one"]).select(
        key, (F.col("_one_before") + 1).alias(code)
    )


def roc_auc(
    df: DataFrame,
    truth: str,
    score: str,
    by: Sequence[str] = (),
    ranges: Ranges | None = None,
) -> DataFrame:
    """Area under the ROC curve of a 0/1 `truth` per group; larger scores mean 1, ties count half.

    Rows are counted per distinct score first, so equal scores cannot fill a task. Wins are
    summed within score ranges; a range then adds its positives times all negatives of the
    ranges below it.
    """
    usable = F.col(truth).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score)
    known = df.where(usable).select(
        *by, F.col(truth).alias("_truth"), F.col(score).alias("_score")
    )
    if ranges is None:
        ranges = find_ranges(known.select("_score").distinct(), "_score")
    counts = known.groupBy(*by, ranges.number("_score").alias("_range"), "_score").agg(
        F.sum(F.when(F.col("_truth") == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col("_truth") == 0, 1).otherwise(0)).alias("_neg"),
    )
    return roc_auc_of_counts(counts, by)


def roc_auc_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As `roc_auc`, from the positives and negatives (_pos, _neg) of every score (_range, _score)."""
    return roc_auc_of_ranges(wins_of_ranges(counts, by), by)


def wins_of_ranges(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, _range, _wins, _pos, _neg): pairs that are won within each range, from the counts of its scores."""
    groups = [*by, "_range"]
    inside = Window.partitionBy(*groups).orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("_neg").over(inside), F.lit(0)).cast("double")
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    return counts.withColumn("_wins", pos * (lower + neg / 2)).groupBy(*groups).agg(*[F.sum(c).alias(c) for c in ("_wins", "_pos", "_neg")])


def roc_auc_of_ranges(ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The area from the wins and counts of the ranges: positives of a range also win against all negatives below it."""
    # This window sees one row per range.
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.col("_pos").cast("double")
    lower = F.coalesce(F.sum("_neg").over(below), F.lit(0)).cast("double")
    return ranges.withColumn("_wins", F.col("_wins") + pos * lower).groupBy(*by).agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.try_divide(F.sum("_wins"), F.sum(pos) * F.sum(F.col("_neg").cast("double"))).alias("roc_auc"),
    )
