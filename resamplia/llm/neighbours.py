"""Nearest neighbours by collision counting over single random projections.

Each block of vectors has `lines` sorted arrays, one per random projection. A query's windows on
all of them are centred on its own projections and grow by a factor (virtual rehashing: no
bucket borders are ever fixed). A vector that lies in at least `needed` of the windows is
verified by its exact cosine. Windows grow until a vector as near as the k-th best found would
have been counted with high probability, or all vectors are inside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


LINES = 64
NEEDED = 0.6
GROWTH = 1.35
SIGMAS = 2.5
DATA_BLOCK, QUERY_BLOCK = 20_000, 2_000
FOUND = "query_id long, vec_id long, score double"


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores."""
    return (vectors * query).sum(axis=1) / (norms * norm)


def _inside(width: float, distance: float) -> float:
    return math.erf(width / (max(distance, 1e-12) * math.sqrt(2)))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, lines: int, seed: int) -> list[tuple[int, int, float]]:
    """The k best (query_id, vec_id, score) within one block of vectors."""
    n, d = vectors.shape
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    axes = np.random.default_rng(seed).standard_normal((d, lines))
    places = (vectors / norms[:, None]) @ axes
    order = np.argsort(places, axis=0, kind="stable").T.astype(np.int32)
    arrays = [np.ascontiguousarray(places[order[j], j]) for j in range(lines)]
    order = [np.ascontiguousarray(x) for x in order]
    needed = math.ceil(NEEDED * lines)
    out = []
    for query_id, query in zip(query_ids.tolist(), queries, strict=True):
        norm = float(np.sqrt((query * query).sum()))
        at = (query / norm) @ axes
        middle = [int(np.searchsorted(a, x)) for a, x in zip(arrays, at, strict=True)]
        low, high = list(middle), list(middle)
        counts = np.zeros(n, np.int32)
        verified = np.zeros(n, bool)
        best: list[tuple[float, int]] = []
        width = 0.25
        while True:
            fresh = []
            for j in range(lines):
                a = int(np.searchsorted(arrays[j], at[j] - width, side="left"))
                b = int(np.searchsorted(arrays[j], at[j] + width, side="right"))
                fresh += [order[j][a : low[j]], order[j][high[j] : b]]
                low[j], high[j] = a, b
            counts += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            new = np.flatnonzero((counts >= needed) & ~verified)
            if len(new):
                verified[new] = True
                new = new[ids[new] != query_id]
                scores = cosines(vectors[new], norms[new], query, norm)
                keep = np.lexsort((ids[new], -scores))[:k]
                best = sorted([*best, *zip((-scores[keep]).tolist(), ids[new][keep].tolist(), strict=True)])[:k]
            if all(b - a == n for a, b in zip(low, high, strict=True)):
                break
            if len(best) == k:
                p = _inside(width, math.sqrt(max(0.0, 2 + 2 * best[-1][0])))
                if lines * p - SIGMAS * math.sqrt(lines * p * (1 - p)) >= needed:
                    break
            width *= GROWTH
        out += [(query_id, vec, -score) for score, vec in best]
    return out


def _block(k: int, lines: int, seed: int):
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = table.column("v").combine_chunks().flatten().to_numpy()
        return table.column("vec_id").to_numpy(), rows.reshape(table.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        found = search(*matrix(left), *matrix(right), k, lines, seed)
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds) if found else kinds.empty_table()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, lines: int = LINES, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine, ties to the smaller vec_id.

    Both tables have vec_id and embedding (an array of numbers). Null, empty or zero vectors,
    vectors with null or non-finite components and null vec_ids take no part, and
    vectors of different lengths are not compared. Rows of the query's own vec_id are not its
    neighbours. A repeated row of `vectors` is found as often as it is there; repeated queries count once.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        limit = 1.7976931348623157e308
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit)) & F.exists(v, lambda x: x != 0)
        return df.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & good).withColumn("d", F.size("v"))

    data, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id", "v"])
    data_blocks = -(-max(1, data.count()) // DATA_BLOCK)
    query_blocks = -(-max(1, asked.count()) // QUERY_BLOCK)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    # Every block of queries meets every block of vectors.
    left = data.withColumn("a", of(data_blocks)).withColumn("b", spread(query_blocks))
    right = asked.withColumn("b", of(query_blocks)).withColumn("a", spread(data_blocks))
    keys = ["d", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k, lines, seed), FOUND)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

