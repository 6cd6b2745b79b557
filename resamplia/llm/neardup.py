"""Near-duplicate documents by a signature-coordinate inverted join.

A document's distinct word shingles have a MinHash signature. It is posted under its
(coordinate, value) pairs; documents with equal shingle sets count as one. Two documents whose
signatures agree in m of the POSTED coordinates share one of the POSTED - m + 1 pairs of either that are rarest in the whole corpus, so only this prefix is merged and the long lists are skipped; the
remaining coordinates are compared for those that meet.

A list of many near copies is not turned into pairs. First each member is compared with the
list's most central member, and what this links is united. Only members of a list that are still
apart are then compared with one another, in blocks, by their signatures; those with enough
collisions are confirmed, like all links, on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resamplia.llm.components import components
from resamplia.llm.postings import best_centres, few_pairs, key_filter, may_be_key, open_blocks, open_lists, postings, repeated
from resamplia.llm.shared import HASHED_BYTES, forget, pieces, released, stored, texts, written
from resamplia.llm.words import NOT_SPACE, find, mix, numbers, shingle_sets

SHINGLE, PERCENT = 3, 85
# Posted coordinates, and more of which one byte each is kept. A pair that is just similar enough agrees in fewer than
# `least_matches` of them, SIGMAS standard deviations below the mean, once in some 10,000.
POSTED, MORE, SIGMAS = 48, 208, 4
# Members of a block; lists of up to FEW members are compared pair by pair.
BLOCK, FEW = 1024, 6

SCAN = "doc_id long, n_shingles long, rid binary, posts array<long>, more binary"


def least_matches(coordinates: int, percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(p * coordinates - SIGMAS * math.sqrt(p * (1 - p) * coordinates)))


def minima(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Least product of each set's numbers with each factor; sets are not empty."""
    values = np.concatenate(sets)
    begin = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=begin[1:])
    out = np.empty((len(sets), len(factors)), values.dtype)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(values * f, begin)
    return out


def signature(sets: list[np.ndarray], posted: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the posted coordinates, which differ between coordinates, and bytes of the others."""
    first = minima(sets, numbers(11, posted) | np.uint64(1))
    keys = mix(first + numbers(12, posted)[None, :])
    short = [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
    rest = minima(short, (numbers(13, more) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
    return keys, ((rest * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def _scan(n: int, posted: int, more: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches, "text", HASHED_BYTES):
            w = find(*texts(batch.column("text")), NOT_SPACE)
            sets = shingle_sets(w.hash, w.first, n)
            some = [i for i, s in enumerate(sets) if len(s)]
            ids: list = [None] * len(sets)
            posts: list = [None] * len(sets)
            rest: list = [None] * len(sets)
            if some:
                keys, codes = signature([sets[i] for i in some], posted, more)
                for row, i in enumerate(some):
                    ids[i], posts[i], rest[i] = set_id(sets[i]), keys[row].view(np.int64), codes[row].tobytes()
            own = [c for c in batch.schema.names if c == "_text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(posts, pa.list_(pa.int64())), pa.array(rest, pa.binary()), *[batch.column(c) for c in own]],
                ["doc_id", "n_shingles", "rid", "posts", "more", *own],
            )

    return run


def word_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    w = find(*texts(column), NOT_SPACE)
    return shingle_sets(w.hash, w.first, n)


def _texts(n: int, bits):
    """Texts of the documents whose `key` may be in the filter, with the ids of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", HASHED_BYTES):
            keys = batch.column("key").to_numpy().view(np.uint64)
            some = batch.column("text").filter(pa.array(may_be_key(bits.value, keys)))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in word_sets(some, n)], pa.binary()), some], ["rid", "text"])

    return run


def _confirm(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # a few texts at a time
                part = batch.slice(k, 64)
                keep = []
                for x, y in zip(word_sets(part.column("u_text"), n), word_sets(part.column("v_text"), n), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("u").filter(keep), part.column("v").filter(keep)], ["u", "v"])

    return run


def confirm(pairs: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) of set ids that are similar enough by the full sets of their texts (rid, text)."""
    of = lambda side: known.select(F.col("rid").alias(side), F.col("text").alias(f"{side}_text"))
    met = pairs.join(of("u"), "u").join(of("v"), "v")
    return met.mapInArrow(released(_confirm(n, percent)), "u binary, v binary")


def _compare(n: int, percent: int, collisions: int, posted: int):
    """Links within one block of a list, or between two. Members of different components that collide often enough are compared
    by their full sets, most collisions first; no more links than unite what they connect are returned. A pair that meets in
    several lists is looked at in one."""
    kinds = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        size = table.num_rows
        key = table.column("key")[0].as_py() >> 32
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        posts = table.column("posts").combine_chunks().flatten().to_numpy().reshape(size, posted)
        mask = table.column("prefix").to_numpy()
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint8).reshape(size, -1)
        names, comp = np.unique(np.array([x.hex() for x in table.column("component").to_pylist()]), return_inverse=True)
        own = table.column("own").to_numpy()
        left = np.flatnonzero(own == a)
        right = left if a == b else np.flatnonzero(own == b)
        here = int(np.flatnonzero((posts == key).any(axis=0))[0])
        bits = (np.uint64(1) << np.arange(posted, dtype=np.uint64)).astype(np.uint64)
        us, vs, hits = [], [], []
        for i in left:
            others = right[right > i] if a == b else right
            others = others[comp[others] != comp[i]]
            same = posts[others] == posts[i]
            found = same.sum(axis=1) + (more[others] == more[i]).sum(axis=1)
            common = (same @ bits) & (mask[others] & mask[i]).astype(np.uint64)
            first = (common & (~common + np.uint64(1))) == bits[here]
            good = np.flatnonzero((found >= collisions) & first)
            us.append(np.full(len(good), i))
            vs.append(others[good])
            hits.append(found[good])
        out: list[tuple[bytes, bytes]] = []
        if us:
            u, v, h = (np.concatenate(x) for x in (us, vs, hits))
            rid, texts_ = table.column("rid").to_pylist(), table.column("text")
            sets: dict[int, np.ndarray] = {}
            parent = list(range(len(names)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for k in np.argsort(-h, kind="stable").tolist():
                i, j = int(u[k]), int(v[k])
                x, y = root(comp[i]), root(comp[j])
                if x == y:
                    continue
                for m in (i, j):
                    if m not in sets:
                        sets[m] = word_sets(texts_.slice(m, 1).combine_chunks(), n)[0]
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[x] = y
                    out.append((rid[i], rid[j]))
        return pa.Table.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], schema=kinds)

    return run


def _collide(collisions: int, posted: int):
    """The pairs whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            posts = [batch.column(f"{x}_posts").flatten().to_numpy().reshape(-1, posted) for x in "uv"]
            more = [np.frombuffer(b"".join(batch.column(f"{x}_more").to_pylist()), np.uint8).reshape(batch.num_rows, -1) for x in "uv"]
            keep = pa.array((posts[0] == posts[1]).sum(axis=1) + (more[0] == more[1]).sum(axis=1) >= collisions)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, posted: int = POSTED, more: int = MORE, by_text: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct `shingle`-word shingles have `percent` hundredths of their union
    in common; a shorter text is one shingle. Null, empty and wordless texts have no shingle and are linked
    with nothing. component_id is the smallest doc_id of the component; a null doc_id is never the smallest, and is
    kept only if it stands alone. Repeated rows are copies of one another. Other columns are ignored.

    With `by_text` there is a column _text too, the md5 of the text, and of a component only the smallest doc_id (null last) with
    its smallest _text is kept; only rows equal in both are kept together.
    """
    matches, collisions = least_matches(posted, percent), least_matches(posted + more, percent)
    rows = docs.select("doc_id", "text")
    own_text = ["_text"] if by_text else []
    scanned = rows.withColumn("_text", F.md5(F.coalesce("text", F.lit("")).cast("binary"))) if by_text else rows
    scan = stored(scanned.mapInArrow(released(_scan(shingle, posted, more)), SCAN + ", _text string" * by_text))
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("first")] * by_text
    reps = stored(
        scan.filter("rid is not null").groupBy("rid").agg(F.first("posts").alias("posts"), F.first("more").alias("more"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *first)
    )
    keys = stored(repeated(reps, "posts", reps.count() * posted))
    lists = postings(reps, "rid", "posts", keys)
    # Rarest pairs first; pairs that occur once are rarer than all of these.
    ranked = lists.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("pairs"), F.sum("n").alias("weight"))
    length = posted - matches + 1 - (posted - F.size("pairs"))
    prefix = stored(
        ranked.filter(length > 0).select("rid", "weight", F.transform(F.slice("pairs", 1, length), lambda p: p["key"]).alias("keys"))
    )
    entries = prefix.select("rid", "weight", F.explode("keys").alias("key"))
    best = stored(best_centres(entries))

    # The text of one document of each set that has a partner.
    def texts_of(ids: DataFrame) -> DataFrame:
        chosen = ids.join(reps, "rid").select("rid", F.xxhash64("doc_id").alias("key"))
        bits = docs.sparkSession.sparkContext.broadcast(key_filter(chosen))
        found = rows.withColumn("key", F.xxhash64("doc_id")).mapInArrow(released(_texts(shingle, bits)), "rid binary, text string")
        return written(found.join(chosen.select("rid"), "rid", "left_semi").dropDuplicates(["rid"]), "near-duplicates")

    members = best.select(F.col("u").alias("rid")).unionByName(best.select(F.col("v").alias("rid"))).distinct()
    known = texts_of(members)
    links = stored(confirm(best, known, shingle, percent))
    united = components(links)

    # Lists whose members are not all united, in blocks.
    # 32 bits of each posted value, and a bit for each coordinate in the prefix.
    flags = F.transform("posts", lambda p, k: F.when(F.array_contains("keys", p), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    sketches = prefix.join(reps, "rid").select(
        "rid", F.transform("posts", lambda p: F.shiftright(p, 32).cast("int")).alias("posts"), "more",
        F.aggregate(flags, F.lit(0).cast("long"), lambda x, y: x + y).alias("prefix"),
    )
    lists = stored(open_lists(entries, united))
    # In short lists, pair by pair; those that collide often enough are confirmed like the others.
    pairs = few_pairs(lists, FEW)
    of = lambda side: sketches.select(F.col("rid").alias(side), F.col("posts").alias(f"{side}_posts"), F.col("more").alias(f"{side}_more"))
    near = pairs.join(of("u"), "u").join(of("v"), "v").mapInArrow(released(_collide(collisions, posted)), "u binary, v binary")
    near = stored(near.join(best, ["u", "v"], "left_anti"))
    long_lists = lists.filter(F.col("n") > FEW)
    needed = near.select(F.col("u").alias("rid")).unionByName(near.select(F.col("v").alias("rid"))).unionByName(long_lists.select("rid")).distinct()
    all_known = known.unionByName(texts_of(needed.join(members, "rid", "left_anti")))
    dealt = open_blocks(long_lists, BLOCK).join(sketches.join(all_known, "rid"), "rid")
    in_blocks = dealt.groupBy("key", "a", "b").applyInArrow(_compare(shingle, percent, collisions, posted), "u binary, v binary")
    more_links = stored(confirm(near, all_known, shingle, percent).unionByName(in_blocks))
    final = components(united.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more_links))

    firsts = ["first"] if by_text else []
    of_set = reps.select("rid", "doc_id", *firsts).join(final.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"), *[F.min(c).alias(c) for c in firsts])
    labels = of_set.select("rid", "component").join(least, "component").select("rid", "component_id", *firsts)
    joined = scan.select("doc_id", "n_shingles", "rid", *own_text).join(labels, "rid", "left")
    own = F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == own, own.isNull())
    if by_text:
        kept = F.col("rid").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_text") == F.col("first._text")))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"), *own_text)
