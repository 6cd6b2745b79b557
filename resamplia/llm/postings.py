"""Inverted lists of 64-bit keys.

Most keys occur once. `repeated` finds the others: tasks send their keys in packed arrays, a
key at most once per batch with its count, so a hot key costs as much as any other. Only postings
of repeated keys become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resamplia.llm.shared import released

# Keys that one task sorts, and bits of the filter that tasks apply to their keys.
GROUP_KEYS = 1_000_000
FILTER_BITS = 1 << 24


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all rows, one after the other, and how many each row has. A row is a list of keys or their bytes."""
    if pa.types.is_binary(lists.type):
        return np.frombuffer(b"".join(lists.to_pylist()), np.uint64), pc.binary_length(lists).to_numpy() // 8
    return lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())


def _pack(column: str, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(_flat(batch.column(column))[0], return_counts=True)
            group = (keys % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            names, begin = np.unique(group[order], return_index=True)
            ends = [*begin[1:].tolist(), len(keys)]
            parts = [(g, keys[order[a:b]].tobytes(), counts[order[a:b]].astype(np.int64).tobytes()) for g, a, b in zip(names.tolist(), begin.tolist(), ends, strict=True)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["g", "keys", "counts"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
    order = np.argsort(keys, kind="stable")
    some, begin = np.unique(keys[order], return_index=True)
    total = np.add.reduceat(counts[order], begin) if len(some) else counts
    return pa.table({"key": some[total > 1], "n": total[total > 1]})


def repeated(df: DataFrame, column: str, total: int) -> DataFrame:
    """(key, n) of the keys that occur n > 1 times in the column of lists of keys, or of their bytes; `total` is about the number of keys."""
    groups = max(1, total // GROUP_KEYS)
    return df.select(column).mapInArrow(released(_pack(column, groups)), "g int, keys binary, counts binary").groupBy("g").applyInArrow(_merge, "key long, n long")


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each `key` modulo the filter's size; the size is fixed, so is what is sent."""
    slot = F.pmod("key", F.lit(FILTER_BITS))
    words = keys.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))
    rows = words.collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[[r["w"] for r in rows]] = [r["b"] for r in rows]
    return bits.view(np.uint8)


def may_be_key(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys & np.uint64(FILTER_BITS - 1)).astype(np.uint32)
    return (bits[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8) & np.uint8(1)).view(bool)


def _rows(id_column: str, column: str, bits, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = _flat(batch.column(column))
            ids = batch.column(id_column)
            if width and batch.num_rows:
                data = b"".join(ids.to_pylist())
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data) // width, [None, pa.py_buffer(data)]).cast(pa.binary())
                sizes = len(keys) // len(ids)
            row = np.repeat(np.arange(len(ids)), sizes)
            hit = np.flatnonzero(may_be_key(bits.value, keys))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[hit])), pa.array(keys[hit].view(np.int64))], [id_column, "key"])

    return run


def postings(df: DataFrame, id_column: str, column: str, keys: DataFrame, width: int = 0) -> DataFrame:
    """(id, key, n) for the keys listed in `keys` (key, n). `width`: a row holds many ids of so many bytes, and the bytes of their keys,
    of which each has equally many."""
    bits = df.sparkSession.sparkContext.broadcast(key_filter(keys))
    kind = dict(df.dtypes)[id_column]
    return df.select(id_column, column).mapInArrow(released(_rows(id_column, column, bits, width)), f"{id_column} {kind}, key long").join(keys, "key")


def best_centres(entries: DataFrame) -> DataFrame:
    """(u, v): each member (rid) of the lists `entries` (rid, key, weight) with the list centre that it
    meets most often. The centre of a list is its member of the largest weight. One row per member at
    most, however long the lists are."""
    centres = entries.groupBy("key").agg(F.max(F.struct("weight", "rid")).alias("c"), F.count("*").alias("n")).filter("n > 1")
    met = entries.join(centres, "key").filter("rid != c.rid").groupBy("rid", F.col("c.rid").alias("v"), F.col("c.weight").alias("w")).agg(F.count("*").alias("hits"))
    return met.groupBy("rid").agg(F.max(F.struct("hits", "w", "v")).alias("m")).select(F.col("rid").alias("u"), "m.v")


def open_lists(entries: DataFrame, united: DataFrame) -> DataFrame:
    """Members of the lists that `united` (node, component) leaves in several components: key, rid, component, and
    the list's number of members n."""
    labelled = entries.select("rid", "key").join(united.select(F.col("node").alias("rid"), "component"), "rid", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rid"))
    lists = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    return labelled.join(lists.filter("c1 != c2").select("key", "n"), "key")


def few_pairs(lists: DataFrame, most: int) -> DataFrame:
    """(u, v): pairs of different components within the lists of at most `most` members, each once."""
    short = lists.filter(F.col("n") <= most)
    left = short.select("key", F.col("rid").alias("u"), F.col("component").alias("c"))
    right = short.select("key", F.col("rid").alias("v"), F.col("component").alias("d"))
    return left.join(right, "key").filter("u > v and c != d").select("u", "v").distinct()


def open_blocks(lists: DataFrame, size: int) -> DataFrame:
    """The members of `open_lists`, dealt so that each two blocks of about `size` members of a list meet
    once: key, rid, component, own (block), a <= b."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    inside = lists.withColumn("own", F.pmod(F.xxhash64("rid", "key"), blocks).cast("int"))
    dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("key", "rid", "component", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
