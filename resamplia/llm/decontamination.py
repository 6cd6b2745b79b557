"""Benchmark decontamination: which words of a document lie in a passage of a benchmark item.

A window is a run of `size` words of an item (a shorter item is one window). A document holds a
window if it has all its words in order, so one word shingle of the window is a sufficient prefix.
The prefix is the rarest of the window's shingles, by counts over all documents. Document
shingles that are a prefix are joined to the windows with it; position and length bounds
discard windows that would begin before or end after the document; the rest is
compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resamplia.llm.postings import key_filter, may_be_key
from resamplia.llm.shared import HASHED_BYTES, pieces, released, stored, texts
from resamplia.llm.words import LETTER_OR_DIGIT, LOWER, find, shingles

SIZE = 13
SHINGLE = 3

WINDOWS = "item_id string, size int, words array<string>, keys array<long>"


def _windows(size: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", HASHED_BYTES):
            data, offsets = texts(batch.column("text"))
            w = find(data, offsets, LETTER_OR_DIGIT)
            plain = LOWER[data].tobytes()
            rows: list[tuple] = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                a, b = w.first[i], w.first[i + 1]
                words = [plain[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
                n = min(size, len(words))
                for k in range(len(words) - n + 1 if n else 0):
                    own = w.hash[a + k : a + k + n]
                    keys, _ = shingles(own, np.array([0, n]), min(shingle, n))
                    rows.append((item, n, words[k : k + n], keys.view(np.int64).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)],
                    ["item_id", "size", "words", "keys"],
                )

    return run


def _count_keys(bits, lengths: list[int]):
    """Per task: how often shingles that pass the filter occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in pieces(batches, "text", HASHED_BYTES):
            w = find(*texts(batch.column("text")), LETTER_OR_DIGIT)
            for n in lengths:
                keys, _ = shingles(w.hash, w.first, n)
                some, counts = np.unique(keys[may_be_key(bits.value, keys)], return_counts=True)
                for key, count in zip(some.view(np.int64).tolist(), counts.tolist(), strict=True):
                    seen[key] = seen.get(key, 0) + count
            if len(seen) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["key", "n"])
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["key", "n"])

    return run


def _probe(bits, lengths: list[int], size: int):
    """Each document with its number of words and the shingles that may be a prefix: their
    place, and the words around it that a window could cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", HASHED_BYTES):
            data, offsets = texts(batch.column("text"))
            w = find(data, offsets, LETTER_OR_DIGIT)
            plain = LOWER[data].tobytes()
            at, key, doc, around, before = [], [], [], [], []
            for n in lengths:
                keys, begin = shingles(w.hash, w.first, n)
                hits = np.flatnonzero(may_be_key(bits.value, keys))
                own = np.searchsorted(begin, hits, side="right") - 1
                place = hits - begin[own]
                first, last = w.first[own], w.first[own + 1]
                low = np.maximum(place - (size - 1), 0)
                high = np.minimum(place + size, last - first)
                for f, a, b in zip(first.tolist(), low.tolist(), high.tolist(), strict=True):
                    s, e = w.start[f + a : f + b], w.end[f + a : f + b]
                    around.append(b" ".join([plain[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]).decode())
                at.append(place)
                key.append(keys[hits])
                doc.append(own)
                before.append(place - low)
            at, key, doc, before = (np.concatenate(x) for x in (at, key, doc, before))
            order = np.argsort(doc, kind="stable")
            bounds = np.searchsorted(doc[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            hit = pa.StructArray.from_arrays(
                [pa.array(at[order]), pa.array(key[order].view(np.int64)), pa.array(before[order]), pa.array([around[i] for i in order], pa.string())],
                ["at", "key", "before", "around"],
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), hit)],
                [*[c for c in batch.schema.names if c != "text"], "n_words", "hits"],
            )

    return run


def covered(spans: Column) -> Column:
    """Number of places in the union of spans (start, size)."""
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["size"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("n"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_hit, items (sorted strings), contaminated
    (n_hit > 0 and share * n_hit >= n_words).

    Null or wordless texts have no words and are never hit; null or wordless items have no
    window. Items of equal id count once. Rows that repeat a (doc_id, text) give equal rows. Other
    columns are ignored. Without documents the result is empty; without items nothing is hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    windows = stored(items.mapInArrow(released(_windows(size, shingle)), WINDOWS))
    lengths = list(range(1, shingle + 1))  # shorter items have shorter shingles
    bits = spark.sparkContext.broadcast(key_filter(windows.select(F.explode("keys").alias("key"))))
    texts_only = docs.select("text")
    counts = texts_only.mapInArrow(released(_count_keys(bits, lengths)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    # Windows of equal words are one; each gets the place of its rarest shingle.
    distinct = windows.groupBy("size", "words").agg(F.first("keys").alias("keys"), F.collect_set("item_id").alias("items"))
    places = distinct.select("size", "words", "items", F.posexplode("keys").alias("shift", "key"))
    rarity = places.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rarity.groupBy("size", "words").agg(
        F.min(F.struct("n", "key", "shift")).alias("m"), F.first("items").alias("items")
    ).select("size", "words", "items", "m.n", "m.key", "m.shift")
    prefixes = stored(rarest.filter("n > 0"))
    chosen = spark.sparkContext.broadcast(key_filter(prefixes.select("key")))

    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_text"))
    hit_type = "array<struct<at:long,key:long,before:long,around:string>>"
    probed = stored(keyed.mapInArrow(released(_probe(chosen, lengths, size)), f"doc_id long, _text string, n_words long, hits {hit_type}"))
    places = probed.filter("size(hits) > 0").select("doc_id", "_text", "n_words", F.explode("hits").alias("h")).select("doc_id", "_text", "n_words", "h.*")
    start = F.col("at") - F.col("shift")
    met = places.join(prefixes, "key").filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    same = F.slice(F.split("around", " "), (F.col("before") - F.col("shift") + 1).cast("int"), F.col("size")) == F.col("words")
    found = met.filter((F.col("before") >= F.col("shift")) & same).select(
        "doc_id", "_text", F.struct(start.alias("start"), F.col("size").cast("long").alias("size")).alias("span"), "items"
    )
    # A window that occurs often in a document occurs at distinct places; equal rows give equal spans.
    per_doc = found.groupBy("doc_id", "_text").agg(
        covered(F.collect_set("span")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    right = per_doc.withColumnsRenamed({"doc_id": "_doc", "_text": "_md5"})
    joined = probed.join(right, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_md5")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "_text", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
