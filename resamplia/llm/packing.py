"""Packing of tokenized documents into sequences of a fixed capacity.

A packing depends on the lengths only, so it is planned on the histogram of lengths (at most one
row per length up to the capacity, however many documents there are). Pieces above one third
of the capacity come at most two to a sequence: the largest is paired with the largest partner
that fits, whole runs of equal lengths at once. The smaller ones then fill the
remaining gaps best-fit, longest first. The plan says for each length which ranks go to
which sequences; pieces get their rank by per-partition counts and meet the plan in one small join.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resamplia.llm.shared import HASHED_BYTES, pieces, released, stored
from resamplia.llm.tokens import encoder

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"


def _cutter(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, "text", HASHED_BYTES):
            out: list[list] = [[], [], [], [], []]
            coded = encoder(tokenizer).encode(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                own = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    for column, value in zip(out, (doc, piece, start, len(part), zlib.crc32(part)), strict=True):
                        column.append(value)
            length = np.array(out[3], np.int64)
            # Rank of each piece among those of its length in this task.
            order = np.argsort(length, kind="stable")
            kinds, begins, counts = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(begins, counts) + np.repeat(ranks[kinds], counts)
            ranks[kinds] += counts
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(length), pa.array(out[4], pa.int64()), pa.array(np.full(len(length), task, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank"])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first_rank, last_rank, first_sequence, offset) for `counts` pieces of
    each length: piece number r of a length, first_rank <= r <= last_rank, goes to
    sequence first_sequence + r - first_rank at the offset."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    groups: list[tuple[list[int], int]] = []  # lengths of a sequence, number of such sequences
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            groups.append(([n], left[n]))
            times = left[n]
        else:
            m = large[at]
            times = left[n] // 2 if m == n else min(left[n], left[m])
            if times == 0:  # a single one is left, and no other partner is nearer
                partner = large[at - 1] if at > 0 else None
                times = 1
                groups.append(([n] if partner is None else [n, partner], 1))
                if partner is not None:
                    left[partner] -= 1
            else:
                groups.append(([n, m], times))
                left[m] -= times
        left[n] -= times
        large = [x for x in large if left[x]]
    # Gaps by size; each holds groups of sequences that look alike.
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    for lengths, times in groups:
        gaps.setdefault(capacity - sum(lengths), []).append((lengths, times))
    free = sorted(gaps)

    def put(gap: int, group: tuple[list[int], int]) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(free, gap)
        gaps[gap].append(group)

    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    put(capacity - each * n, ([n] * each, full))
                if rest:
                    put(capacity - rest * n, ([n] * rest, 1))
                left[n] = 0
                break
            gap = free[at]
            lengths, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], free[at]
            each = min(gap // n, left[n])
            used = min(times, left[n] // each)
            if used < times:
                put(gap, (lengths, times - used))
            put(gap - each * n, (lengths + [n] * each, used))
            left[n] -= used * each
    slots, given, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in sorted(gaps):
        for lengths, times in gaps[gap]:
            offset = 0
            for n in lengths:
                slots.append((n, given[n], given[n] + times - 1, sequence, offset))
                given[n] += times
                offset += n
            sequence += times
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents.

    Null text is empty and gives one piece with the end id alone; each row is packed, repeated
    and null doc_ids too. No documents give no rows. Other columns are ignored. `tokenizer` is the
    path of a tokenizers file whose pre-tokenizer splits at white space.
    """
    spark = docs.sparkSession
    cut = stored(docs.select("doc_id", "text").mapInArrow(released(_cutter(tokenizer, capacity, end_id)), PIECES))
    counts = cut.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    # At most one row per length up to the capacity.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity) or [(0, 0, 0, 0, 0)],
        "length long, _from long, _to long, _sequence long, offset long",
    )
    ranked = cut.join(counts.drop("_n"), ["length", "_task"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The plan's size is bounded by the capacity, not by the input.
    placed = ranked.join(
        F.broadcast(slots.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_from"), F.col("_to")),
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset",
    )
