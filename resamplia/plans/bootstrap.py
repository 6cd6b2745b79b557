"""Bootstrap distributions and confidence intervals of model metrics.

    scores = bootstrap_metrics(pairs, times=5000, seed=1) # one row per replicate
    bounds = percentile_ci(to_long(scores, ["replicate"]))
    sets   = analysis_sets(pairs, times=5000, seed=1)     # drawn rows, for functions of your own

`pairs` is (row_ix, truth, estimate) and optionally columns that separate candidate models. Each
model has one row for each row_ix from 0 to n-1, and all models share the draws of a replicate. The draws of
(seed, replicate) are the same in every function here except `gathered_sets`, for any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, inf, isfinite, nextafter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resamplia.functions.metrics import complete_pairs, metrics_from_sums, weighted_sums
from resamplia.operators import joins
from resamplia.operators.joins import counted_size, inner_join_nulls_match, kept
from resamplia.operators.ordered import RANGES, find_ranges, roc_auc_of_ranges
from resamplia.operators.resample import PARTS, PoissonWeights, gather, scan, scan_rate, scan_top_up, task_count, with_poisson_weight

# Up to so many rows a join side is broadcast, if it has few bytes too (`operators.joins`), and a table is spread over all cores.
# It decides the plan only: results are the same on either side.
BROADCAST_ROWS = 1_000_000


def checked_models(pairs: DataFrame, by: Sequence[str] = (), dense: bool = True) -> tuple[DataFrame, int, int]:
    """(models, rows, n): one row per model with the centres of its values, rows of the table and of a model.

    Every model must hold row_ix 0..n-1 once each; an xor of hashes tells, without a shuffle of rows: n
    distinct indexes have the xor of 0..n-1 only if none is missing. With dense=False only nulls and repeated
    keys are refused.
    """

    def centre(name: str) -> Column:
        return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(F.avg(name))

    known = F.col("truth").isNotNull() & F.col("estimate").isNotNull() & ~F.isnan("truth") & ~F.isnan("estimate")
    value = {name: F.when(known, F.col(name)).alias(name) for name in ("truth", "estimate")}
    models = pairs.select("row_ix", *by, *value.values()).groupBy(*by).agg(
        F.count("*").alias("_rows"), F.count("row_ix").alias("_keys"), F.min("row_ix").alias("_low"), F.max("row_ix").alias("_high"),
        F.bit_xor(F.xxhash64("row_ix")).alias("_xor"), centre("truth").alias("_truth"), centre("estimate").alias("_estimate"),
    )
    # Few rows: one per model.
    models = kept(models)
    found = models.agg(F.sum("_rows"), F.min("_rows"), F.max("_rows"), F.min("_low"), F.max("_high"), F.min("_xor"), F.max("_xor"), F.sum("_keys")).first()
    rows, least, most, low, high, xor, xor2, keys = found
    if not rows:
        raise ValueError("no rows to resample")
    if keys != rows:
        raise ValueError("row_ix must not be null")
    if dense:
        ideal = pairs.sparkSession.range(most).agg(F.bit_xor(F.xxhash64("id"))).first()[0]
        if least != most or low != 0 or high != most - 1 or xor != ideal or xor2 != ideal:
            raise ValueError("row_ix must run from 0 to n-1 in every model; see sources.pairs.dense_index")
    elif pairs.groupBy("row_ix", *by).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("row_ix must not be repeated within a model: equal keys get equal weights")
    return models, rows, most


def analysis_sets(pairs: DataFrame, times: int, seed: int, by: Sequence[str] = (), first: int = 1, copy: str | None = None) -> DataFrame:
    """(replicate, *pairs columns): for every replicate first..times, n rows drawn with
    replacement, duplicates kept; draws of rows that lack a value are left out.

    Lazy; nothing is stored. A single replicate k is first=k, times=k: the others are not generated. All draws of a row are in one
    task, so groups by row_ix need no shuffle; `copy` names a column that numbers the copies of a row in a replicate from 1.
    """
    _, rows, size = checked_models(pairs, by)
    return scan(complete_pairs(pairs), size, times, seed, first, rows, copy)


def gathered_sets(
    pairs: DataFrame, times: int, seed: int, by: Sequence[str] = (), first: int = 1, columns: Sequence[str] = ("truth", "estimate")
) -> DataFrame:
    """As `analysis_sets`, from another random stream: draws are generated and looked up in the table. The
    quickest way for small tables; those of more rows are broadcast in parts, up to PARTS of them. Above that, or if the rows are so wide
    that a part has too many bytes, draws are joined by a shuffle. Sets have row_ix, `by` and `columns` only: what nobody asks for is
    neither counted nor sent."""
    _, rows, size = checked_models(pairs, by)
    known = complete_pairs(pairs).select("row_ix", *by, *columns)
    parts = max(1, ceil(rows / BROADCAST_ROWS))
    small = parts <= PARTS and counted_size(known)[1] <= parts * joins.SMALL_BYTES
    return gather(known, size, times, seed, first, parts if small else 0)


def _spread(pairs: DataFrame, rows: int, replicates: int) -> DataFrame:
    """A table of few rows, often one file, over all cores. A large one keeps its partitions."""
    if rows > BROADCAST_ROWS:
        return pairs
    return pairs.repartition(task_count(pairs.sparkSession, rows * replicates, 200_000_000), "row_ix")


def _centred(pairs: DataFrame, models: DataFrame, by: Sequence[str]) -> DataFrame:
    """row_ix, by, and the values around the centres of their model; null where a value is missing."""
    number = ["_model"] if "_model" in models.columns else []
    centres = models.select(*by, *number, "_truth", "_estimate")
    if by:
        joined = inner_join_nulls_match(pairs, centres, by)
    else:
        *_, truth, estimate = centres.first()
        joined = pairs.withColumns({name: F.lit(1).cast("bigint") for name in number} | {"_truth": F.lit(truth).cast("double"), "_estimate": F.lit(estimate).cast("double")})
    known = F.col("truth").isNotNull() & F.col("estimate").isNotNull() & ~F.isnan("truth") & ~F.isnan("estimate")
    return joined.select(
        "row_ix", *by, *number, known.cast("double").alias("known"),
        F.when(known, F.col("truth") - F.col("_truth")).alias("y"), F.when(known, F.col("estimate") - F.col("_estimate")).alias("p"),
        F.when(known, F.col("truth") - F.col("estimate")).alias("error"),
    )


SUMS = ("w", "wy", "wp", "wyy", "wpp", "wyp", "wae", "wse")


def _scores(sums: DataFrame, models: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics and the number of usable draws `n` from the sums of each replicate and model."""
    offset = models.select(*by, (F.col("_truth") - F.col("_estimate")).alias("offset"))
    if by:
        joined = inner_join_nulls_match(sums, offset, by)
    else:
        joined = sums.withColumn("offset", F.lit(offset.first()[0]).cast("double"))
    whole = joined.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in SUMS})
    return whole.select("replicate", *by, *metrics_from_sums(F.col("offset")), F.col("w").cast("bigint").alias("n"))


def _weighted(rows: DataFrame, rate: float, first: int, times: int, seed: int, by: Sequence[str]) -> DataFrame:
    """Sums of each replicate and model under Poisson weights, and `drawn`, the total weight of all rows."""
    weighted = with_poisson_weight(rows, rate, first, times, seed)
    w = F.col("w").cast("double")
    return weighted.groupBy("replicate", *by).agg(
        *weighted_sums(w * F.col("known"), F.col("y"), F.col("p"), F.col("error")), F.sum("w").alias("drawn")
    )


def frame_of(models: DataFrame, by: Sequence[str], first: int, times: int) -> DataFrame:
    """Every replicate with every model."""
    replicates = F.sequence(F.lit(first).cast("bigint"), F.lit(times).cast("bigint"))
    return models.select(*by, F.explode(replicates).alias("replicate"))


# Rows of a piece (of all models), replicates that are scored at a time, weights in memory, and draws that a piece is sent at most.
PIECE_ROWS, PIECE_SETS, WEIGHTS, PIECE_DRAWS = 1 << 15, 5000, 1 << 20, 1 << 20


def _sums_of_piece(rate: float, seed: int, span: int, size: int, first: int, times: int, groups: int, schema: pa.Schema):
    """Rows of one piece, and the added draws of one group of replicates: weighted sums for each replicate and model."""

    def terms(rows: pa.Table) -> np.ndarray:
        y, p, error = (rows[c].to_numpy(zero_copy_only=False) for c in ("y", "p", "error"))
        known = rows["known"].to_numpy() > 0
        with np.errstate(all="ignore"):
            return np.where(known[:, None], np.stack([np.ones(len(y)), y, p, y * y, p * p, y * p, abs(error), error * error], axis=1), 0.0)

    def run(key: tuple, rows: pa.Table, added: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        low, group = key[0].as_py() * span, key[1].as_py()
        n, sets = min(low + span, size) - low, times - first + 1
        weights = PoissonWeights(rate, seed, low, low + n)
        models, model = np.unique(rows["_model"].to_numpy(), return_inverse=True)
        values = np.zeros((n, len(models), len(SUMS)))
        values[rows["row_ix"].to_numpy() - low, model] = terms(rows)
        values = values.reshape(n, -1)
        # A value that is not finite counts only where its row is drawn.
        odd = np.flatnonzero(~np.isfinite(values).all(axis=1))
        odd_values, values[odd] = values[odd], 0.0
        replicate = added["replicate"].to_numpy()
        order = np.argsort(replicate, kind="stable")
        replicate, place = replicate[order], (added["row_ix"].to_numpy() - low)[order]
        begin, end = first - (-group * sets // groups), first - (-(group + 1) * sets // groups)
        step, found = max(1, WEIGHTS // n), []
        for b in range(begin, end, step):
            some = range(b, min(b + step, end))
            w = weights.matrix(some.start, some.stop)
            mine = slice(*np.searchsorted(replicate, [some.start, some.stop]))
            w += np.bincount((replicate[mine] - b) * n + place[mine], minlength=w.size).reshape(w.shape)
            sums = w.astype(np.float64) @ values
            with np.errstate(all="ignore"):
                for row, value in zip(odd, odd_values, strict=True):
                    hit = np.flatnonzero(w[:, row])
                    sums[hit] += w[hit, row, None] * value
            found.append(sums)
        sums = np.concatenate(found).reshape(-1, len(SUMS))
        keys = [np.repeat(np.arange(begin, end), len(models)), np.tile(models, end - begin)]
        return pa.Table.from_arrays([pa.array(c) for c in (*keys, *sums.T.copy())], schema=schema)

    return run


def bootstrap_metrics(pairs: DataFrame, times: int, seed: int, by: Sequence[str] = (), first: int = 1) -> DataFrame:
    """rmse, rsq, mae, ccc and n, one row for every replicate first..times and model.

    n counts the draws that have both values; a replicate without any has null metrics. A task gets the rows of a piece, with all
    models, and the added draws of these rows. It makes the weights of the rows for each replicate, and their product with the terms
    of the sums is all that leaves it. No row is copied or moved per draw.
    """
    models, rows, size = checked_models(pairs, by)
    spark, sets = pairs.sparkSession, times - first + 1
    # One row per model: their numbers travel instead of their names.
    numbered = models.withColumn("_model", F.row_number().over(Window.orderBy(*by)).cast("bigint")) if by else models.withColumn("_model", F.lit(1).cast("bigint"))
    numbered = kept(numbered)
    data = _centred(pairs.select("row_ix", *by, "truth", "estimate"), numbered, by)
    rate = scan_rate(size)
    added = int(sets * (1.0 - rate) * size)
    span = ceil(size / min(size, max(ceil(rows / PIECE_ROWS), ceil(added / PIECE_DRAWS), task_count(spark, size * sets, 200_000_000))))
    pieces = ceil(size / span)
    groups = min(sets, max(ceil(sets / PIECE_SETS), ceil(added / (pieces * PIECE_DRAWS))))
    # Twice the units: few partitions get several of them.
    tasks, unit = 2 * pieces * groups, ["_piece", "_group"]
    piece = F.expr(f"row_ix div {span}").alias("_piece")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("_group")
    dealt = data.select(piece, "row_ix", "_model", "known", "y", "p", "error", each).repartition(tasks, *unit)
    draws = scan_top_up(spark, size, times, seed, first)
    sent = draws.select(piece, F.expr(f"(replicate - {first}) * {groups} div {sets}").alias("_group"), "replicate", "row_ix").repartition(tasks, *unit)
    schema = T.StructType([T.StructField("replicate", T.LongType()), T.StructField("_model", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in SUMS]])
    found = dealt.groupBy(*unit).cogroup(sent.groupBy(*unit)).applyInArrow(_sums_of_piece(rate, seed, span, size, first, times, groups, to_arrow_schema(schema)), schema)
    sums = found.groupBy("replicate", "_model").agg(*[F.sum(c).alias(c) for c in SUMS])
    frame = frame_of(numbered, [*by, "_model"], first, times)
    return _scores(frame.join(sums, ["replicate", "_model"], "left").drop("_model"), models, by)


# A score with more rows than a task's even share divided by this is dealt to several tasks; at most this times the tasks can be such.
HOT_PART = 2
# Parts of a hot score for each task, so that tasks get about equal numbers of them.
PARTS_PER_TASK = 8


def _auc_parts(rows: DataFrame, count: int, tasks: int) -> tuple[DataFrame, list[float]]:
    """Rows with their range of scores (`_range`) and their part of it (`_part`), and the hot scores.

    Ranges keep equal scores together, because wins are counted in the order of scores. A score that many rows share is a range of its
    own: there, half of all pairs are won in any order, so its rows are dealt out by a hash of their number.
    """
    scores = rows.groupBy("estimate").count().where(F.col("count") > max(1, count // (HOT_PART * tasks)))
    # No cut can be put below the lowest of all numbers.
    hot = sorted(r["estimate"] for r in scores.where(F.col("estimate") > -inf).collect())
    cuts = [c for score in hot for c in (nextafter(score, -inf), score) if isfinite(c)]
    # Percentiles of rows, not of distinct scores: ranges have about equal rows.
    ranges = find_ranges(rows.select("estimate"), "estimate").with_cuts(cuts)
    part = F.when(F.col("estimate").isin(hot), F.pmod(F.xxhash64("row_ix"), F.lit(PARTS_PER_TASK * tasks))).otherwise(0) if hot else F.lit(0)
    return rows.withColumns({"_range": ranges.number("estimate"), "_part": part.cast("int")}), hot


def _wins_of_units(rate: float, seed: int, first: int, times: int, groups: int, schema: pa.Schema):
    """Rows of a range (or of a part of it) and the added draws among them: pairs won, positives and negatives for each replicate
    of a group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group, sets = key[2].as_py(), times - first + 1
        begin, end = first - (-group * sets // groups), first - (-(group + 1) * sets // groups)
        # An added draw comes with its row, which is there too: their numbers tell which.
        own, single = rows.filter(pc.greater_equal(rows["_entry"], 0)), rows.filter(pc.less(rows["_entry"], 0))
        own = own.take(np.argsort(own["estimate"].to_numpy(), kind="stable"))
        number, score = own["row_ix"].to_numpy(), own["estimate"].to_numpy()
        n = len(number)
        starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        positive = own["truth"].to_numpy() == 1
        by_number = np.argsort(number)
        replicate = -single["_entry"].to_numpy()
        order = np.argsort(replicate, kind="stable")
        replicate, place = replicate[order], by_number[np.searchsorted(number, single["row_ix"].to_numpy()[order], sorter=by_number)]
        weights = PoissonWeights(rate, seed, 0, 0, number)
        step, found = max(1, WEIGHTS // n), []
        for b in range(begin, end, step):
            some = range(b, min(b + step, end))
            w = weights.matrix(some.start, some.stop)
            mine = slice(*np.searchsorted(replicate, [some.start, some.stop]))
            w += np.bincount((replicate[mine] - b) * n + place[mine], minlength=w.size).reshape(w.shape)
            every, pos = (np.add.reduceat(x, starts, axis=1) for x in (w, w * positive))
            neg = every - pos
            wins = (pos * (np.cumsum(neg, axis=1) - neg / 2)).sum(axis=1)
            found.append((wins, pos.sum(axis=1), neg.sum(axis=1)))
        wins, pos, neg = (np.concatenate(x) for x in zip(*found, strict=True))
        constant = [pa.array([k.as_py()] * (end - begin), pa.int32()) for k in key[:2]]
        return pa.Table.from_arrays([pa.array(np.arange(begin, end)), *constant, pa.array(wins), pa.array(pos), pa.array(neg)], schema=schema)

    return run


def bootstrap_auc(pairs: DataFrame, times: int, seed: int, first: int = 1) -> DataFrame:
    """ROC AUC per replicate of a 0/1 `truth` and a score `estimate`; every row must have both.

    The rows are moved once, to their range of scores, each with the replicates in which it is an added draw;
    weights, counts per score and wins are computed there, and one row per replicate and range leaves. Hot scores are counted in
    several parts, whose counts are added: one row per replicate and part.
    """
    rows = complete_pairs(pairs).where(F.col("truth").isin(0, 1))
    _, count, size = checked_models(rows)
    rate, sets, spark = scan_rate(size), times - first + 1, pairs.sparkSession
    extra = scan_top_up(spark, size, times, seed, first).groupBy("row_ix").agg(F.collect_list("replicate").alias("_extra"))
    tasks = task_count(spark, count * sets, 20_000_000)
    ranged, hot = _auc_parts(rows, count, tasks)
    # Each row once for each group of replicates, and once, with a negative number, for each added draw.
    groups = min(sets, max(ceil(sets / PIECE_SETS), ceil(count * sets / (RANGES * 200_000_000))))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))
    both = F.concat(numbers, F.transform(F.coalesce("_extra", F.array().cast("array<bigint>")), lambda r: -r))
    group = F.when(F.col("_entry") >= 0, F.col("_entry")).otherwise(F.expr(f"(-_entry - {first}) * {groups} div {sets}"))
    schema = "replicate long, _range int, _part int, _wins double, _pos long, _neg long"
    unit = _wins_of_units(rate, seed, first, times, groups, to_arrow_schema(T.StructType.fromDDL(schema)))

    def counted(placed: DataFrame, *by: str) -> DataFrame:
        moved = placed.join(extra, "row_ix", "left").repartition(tasks, *by)
        each = moved.select("row_ix", "truth", "estimate", "_range", "_part", F.explode(both).alias("_entry")).withColumn("_group", group)
        return each.groupBy("_range", "_part", "_group").applyInArrow(unit, schema)

    is_hot = F.col("estimate").isin(hot) if hot else F.lit(False)
    wins = counted(ranged.where(~is_hot), "_range").drop("_part")
    if hot:
        # Counted in each part first, then over the parts.
        parts = counted(ranged.where(is_hot), "_range", "_part")
        whole = parts.groupBy("replicate", "_range").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
        half = F.col("_pos").cast("double") * F.col("_neg").cast("double") / 2
        wins = wins.unionByName(whole.withColumn("_wins", half))
    return roc_auc_of_ranges(wins, ["replicate"])


def poisson_metrics(pairs: DataFrame, times: int, seed: int, by: Sequence[str] = (), first: int = 1) -> DataFrame:
    """As `bootstrap_metrics`, with independent Poisson(1) weights for the rows.

    The cheapest form for huge tables: one pass, no join of draws, and the shuffle carries one row
    of sums per replicate, model and task. row_ix may be any key that is not null and not repeated within
    a model. The total weight of a replicate varies around n, so this is the Poisson bootstrap
    and not a draw of exactly n rows.
    """
    models, rows, _ = checked_models(pairs, by, dense=False)
    data = _spread(_centred(pairs.select("row_ix", *by, "truth", "estimate"), models, by), rows, times - first + 1)
    sums = _weighted(data, 1.0, first, times, seed, by)
    found = inner_join_nulls_match(frame_of(models, by, first, times), sums, ["replicate", *by], "left")
    return _scores(found, models, by)


def percentile_ci(scores: DataFrame, keys: Sequence[str] = ("metric",), level: float = 0.95) -> DataFrame:
    """Percentile interval and mean of `estimate` over the replicates of each key, and the number of
    replicates that have a value.

    Exact percentiles: a group holds one value per replicate, however large the data is. For very many replicates
    see `plans.sketches.percentile_bounds`.
    """
    tail = round((1.0 - level) / 2.0, 12)
    bounds = F.percentile("estimate", F.array(F.lit(tail), F.lit(round(1.0 - tail, 12))))
    return (
        scores.groupBy(*keys)
        .agg(bounds.alias("_bounds"), F.avg("estimate").alias("mean"), F.count("estimate").alias("replicates"))
        .select(*keys, F.col("_bounds")[0].alias("lower"), "mean", F.col("_bounds")[1].alias("upper"), "replicates")
    )


def reduce_sets(
    sets: DataFrame,
    partial: Callable[[pd.DataFrame], dict[str, float]],
    sums: Sequence[str],
    keys: Sequence[str] = ("replicate",),
) -> DataFrame:
    """Run a user's pandas function over the analysis sets, piece by piece.

    `partial` gets some rows of one analysis set and returns sums; the sums of all pieces are
    added by Spark. No analysis set has to fit in one task, and no drawn row is shuffled.
    """
    names, by = list(sums), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, part in batch.groupby(by, sort=False, dropna=False):
                found = partial(part)
                rows.append([*key, *[float(found[name]) for name in names]])
            yield pd.DataFrame(rows, columns=by + names)

    schema = T.StructType(
        [sets.schema[key] for key in by] + [T.StructField(name, T.DoubleType()) for name in names]
    )
    # Rows of a set lie together within a partition, so that the function is called once for each.
    pieces = sets.sortWithinPartitions(*by).mapInPandas(run, schema)
    return pieces.groupBy(*by).agg(*[F.sum(name).alias(name) for name in names])
