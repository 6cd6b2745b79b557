"""A manifest of a data set: Merkle trees over its rows, kept as a postorder append log, with proofs.

A tree's nodes are appended when they are complete, children before their parent. Where a node of a tree of n leaves
stands in this log follows from the sizes of the subtrees before it (`position`), so that any sibling can be
addressed without a search and without pointers.

Builders are aligned: one takes 2**levels consecutive nodes, and whatever it completes belongs to no other. The first
tier starts from the leaves, each further one from the roots of the tier before, until one node is left; a
tree of any size is some log(n) / levels tiers, and no builder holds more than 2**levels digests of a tree. Leaves get
their places from a sort into ranges, so one hot tree is many tasks.

Every two consecutive nodes become H of both; a last single one becomes H of itself, as long as a level has more than
one node. H is lowercase hex sha256 of the hex digests, one after the other.

Nulls: a null value is `-` in a leaf's record; null keys and null tree names come first. Rows with the same key are
ordered by their leaf, equal rows are leaves of their own. An empty table has no rows and no trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resamplia.llm.shared import partitions, written

# Levels of nodes that one builder completes.
LEVELS = 10


def record(columns: Sequence[Column]) -> Column:
    """The values as one string: `-` if null, else the number of UTF-8 bytes, `:`, the value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def digest(columns: Sequence[Column]) -> Column:
    return F.sha2(record(columns).cast("binary"), 256)


def position(level: int, index: int, leaves: int, height: int) -> int:
    """Where node `index` of `level` stands in the log of a tree: behind all nodes that are complete before it. These are, up
    to its own level, the nodes that cover its leaves and those before them, and above, the nodes that end before it begins."""
    end = min((index + 1) << level, leaves)
    below = sum(-(-end >> k) for k in range(level + 1))
    above = sum(index >> k for k in range(1, height - level + 1))
    return below + above - 1


def height_of(leaves: int) -> int:
    return (leaves - 1).bit_length()


def _joined(nodes: list[bytes]) -> list[bytes]:
    out = [hashlib.sha256(a + b).hexdigest().encode() for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
    if len(nodes) % 2:
        out.append(hashlib.sha256(nodes[-1]).hexdigest().encode())
    return out


def _hex(data: bytes) -> list[bytes]:
    text = data.hex().encode()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def _built(digests: list[bytes], tier: int, block: int, leaves: int, levels: int) -> tuple[list[int], list[bytes]]:
    """The nodes that one builder completes, from its digests on, in the order of the log, with their places."""
    height = height_of(leaves)
    base = tier * levels
    found, level, now, first = [], base, digests, block << levels
    while True:
        found += [(position(level, first + k, leaves, height), x) for k, x in enumerate(now)]
        if level == min(base + levels, height):
            break
        now, level, first = _joined(now), level + 1, first >> 1
    found.sort()
    return [p for p, _ in found], [x for _, x in found]


def _builder(tier: int, carried: list[str], levels: int) -> Callable[[pa.Table], pa.Table]:
    """Builds one block: rows of (tree, block, rank, digest, leaves) and carried columns."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        row = table.slice(0, 1)
        leaves, block = row["leaves"][0].as_py(), row["block"][0].as_py()
        places, nodes = _built([x.encode() for x in table["digest"].to_pylist()], tier, block, leaves, levels)
        columns = {
            "tree": row["tree"].combine_chunks(),
            "block": pa.array([block], pa.int64()),
            "leaves": pa.array([leaves], pa.int64()),
            "places": pa.array([np.array(places, np.int64).tobytes()], pa.binary()),
            "nodes": pa.array([bytes.fromhex(b"".join(nodes).decode())], pa.binary()),
            "top": pa.array([nodes[-1].decode()], pa.string()),
        }
        for c in carried:
            values = table[c].combine_chunks()
            columns[c] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(columns)

    return run


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows`, which have a column `tree`, with `rank` (from 0 within the tree, ordered by the columns `order`) and `leaves` (rows of the tree).
    Rows are sorted into ranges, numbered there, and shifted by the counts of the ranges before; equal rows are told apart
    by their place in a stored table, so that copies are no single range."""
    spark = rows.sparkSession
    kept = written(rows.withColumn("_row", F.monotonically_increasing_id()), "manifest-rows")
    keys = ["tree", *order, "_row"]
    sorted_rows = kept.repartitionByRange(max(2, partitions(spark)), *keys).sortWithinPartitions(*keys).drop("_row")
    ranged = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "manifest-order")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    # A row for each range and tree: few, and what the windows see.
    parts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("tree").alias("_tree"), F.col("_part").alias("_p"), "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("leaves"))
    met = ranged.join(parts, (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return met.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_tree", "_p", "_first", "_before")


class Forest:
    """Built trees: one table of blocks per tier, with columns tree, block, leaves, places and nodes (the segment of the log that the
    builder wrote), top (its last node); in the first tier also the carried columns, as lists in the order of the leaves."""

    def __init__(self, rows: DataFrame, order: Sequence[str], carried: Sequence[str] = (), levels: int = LEVELS):
        """`rows`: tree, digest (hex), the columns to order by and to carry."""
        self.levels = levels
        now = numbered(rows, order).select("tree", "digest", "rank", "leaves", *carried)
        name = dict(rows.dtypes)["tree"]
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        base = f"tree {name}, block long, leaves long, places binary, nodes binary, top string"
        self.tiers: list[DataFrame] = []
        while True:
            tier, own = len(self.tiers), list(carried) if not self.tiers else []
            schema = ", ".join([base, *(f"`{c}` array<{kinds[c]}>" for c in own)])
            blocks = now.withColumn("block", F.shiftright("rank", levels)).groupBy("tree", "block")
            self.tiers.append(written(blocks.applyInArrow(_builder(tier, own, levels), schema), f"manifest-tier{tier}"))
            open_trees = self.tiers[-1].filter(F.col("leaves") > F.lit(1 << (levels * (tier + 1))))
            if open_trees.limit(1).count() == 0:
                return
            now = open_trees.select("tree", F.col("top").alias("digest"), F.col("block").alias("rank"), "leaves")

    def roots(self) -> DataFrame:
        """(tree, root, leaves): one row per tree."""
        tops = [t.filter(F.col("leaves") <= F.lit(1 << (self.levels * (k + 1)))) for k, t in enumerate(self.tiers)]
        return reduce(DataFrame.unionByName, [t.select("tree", F.col("top").alias("root"), "leaves") for t in tops])

    def log(self) -> DataFrame:
        """(tree, place, node): every node once, at its place in the log of its tree."""
        schema = f"tree {dict(self.tiers[0].dtypes)['tree']}, place long, node string"
        segments = [t.select("tree", "block", "leaves", "places", "nodes") for t in self.tiers]
        return reduce(DataFrame.unionByName, [t.mapInArrow(_log_rows(k, self.levels), schema) for k, t in enumerate(segments)])

    def proofs(self) -> DataFrame:
        """The first tier's blocks with `above` and `side`: the siblings of the block's top up to the root (32 bytes each), and for
        every level whether the sibling is left (-1), right (1) or there is none (0)."""
        upper = None
        for k in reversed(range(1, len(self.tiers))):
            upper = self._with_upper(k, upper).mapInArrow(_child_paths(k, self.levels), f"tree {dict(self.tiers[k].dtypes)['tree']}, block long, above binary, side binary")
        return self._with_upper(0, upper)

    def _with_upper(self, tier: int, upper: DataFrame | None) -> DataFrame:
        blocks, empty = self.tiers[tier], F.lit(b"")
        if upper is None:
            return blocks.withColumns({"above": empty, "side": empty})
        upper = upper.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "above", "side")
        met = blocks.join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")), "left").drop("_tree", "_block")
        return met.withColumns({"above": F.coalesce("above", empty), "side": F.coalesce("side", empty)})


class _Segment:
    """The nodes of one builder, and the siblings of those it started from, addressed by their places in the log."""

    def __init__(self, row: dict, tier: int, levels: int):
        leaves = row["leaves"]
        height, base = height_of(leaves), tier * levels
        nodes = dict(zip(np.frombuffer(row["places"], np.int64).tolist(), _hex(row["nodes"]), strict=True))
        self.first = row["block"] << levels
        self.size = min(1 << levels, -(-leaves >> base) - self.first)
        #: By level, from the block's first node on. The sibling of an index has the last bit turned; blocks are aligned, so it is here.
        self.rows = [
            [nodes[position(base + k, i, leaves, height)] for i in range(self.first >> k, (self.first + self.size - 1 >> k) + 1)]
            for k in range(min(levels, height - base) + 1)
        ]

    def path(self, number: int) -> tuple[list[bytes], list[int]]:
        """Siblings and sides for the block's node `number`, lowest level first: -1 left, 1 right, 0 if there is none."""
        siblings, sides = [], []
        for row in self.rows[:-1]:
            other = number ^ 1
            if other < len(row):
                siblings.append(row[other])
                sides.append(1 if other > number else -1)
            else:
                sides.append(0)
            number >>= 1
        return siblings, sides


def _rows(batches: Iterator[pa.RecordBatch], skip: str = "") -> Iterator[tuple[pa.RecordBatch, dict]]:
    """One by one, as a batch and as values without the column `skip`."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != skip]
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row, row.select(names).to_pylist()[0]


def _log_rows(tier: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _rows(batches, "tree"):
            nodes = dict(zip(np.frombuffer(row["places"], np.int64).tolist(), _hex(row["nodes"]), strict=True))
            if tier:  # the roots of the tier before stand there already
                first, leaves = row["block"] << levels, row["leaves"]
                for k in range(first, min(first + (1 << levels), -(-leaves >> (tier * levels)))):
                    del nodes[position(tier * levels, k, leaves, height_of(leaves))]
            tree = batch.column("tree").take(pa.array([0] * len(nodes), pa.int32()))
            yield pa.RecordBatch.from_arrays([tree, pa.array(list(nodes), pa.int64()), pa.array([x.decode() for x in nodes.values()], pa.string())], ["tree", "place", "node"])

    return run


def _packed(siblings: list[bytes], sides: list[int], row: dict) -> tuple[bytes, bytes]:
    """A node's path in its block and that of the block's top as one."""
    return bytes.fromhex(b"".join(siblings).decode()) + row["above"], np.array(sides, np.int8).tobytes() + row["side"]


def _child_paths(tier: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block of the tier below, the siblings of its top up to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _rows(batches, "tree"):
            segment = _Segment(row, tier, levels)
            paths = [_packed(*segment.path(k), row) for k in range(segment.size)]
            tree = batch.column("tree").take(pa.array([0] * segment.size, pa.int32()))
            block = pa.array(range(segment.first, segment.first + segment.size), pa.int64())
            above, side = (pa.array(x, pa.binary()) for x in zip(*paths, strict=True))
            yield pa.RecordBatch.from_arrays([tree, block, above, side], ["tree", "block", "above", "side"])

    return run


def folded(leaf: bytes, siblings: Sequence[bytes], sides: Sequence[int]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    now, next_one = leaf, iter(siblings)
    for side in sides:
        if side > 0:
            now = hashlib.sha256(now + next(next_one)).hexdigest().encode()
        elif side < 0:
            now = hashlib.sha256(next(next_one) + now).hexdigest().encode()
        else:
            now = hashlib.sha256(now).hexdigest().encode()
    return now


OUT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verify(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From blocks of a tree and the path of its subroot: one row per leaf, folded from the leaf that is claimed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _rows(batches, "key"):
            segment = _Segment(row, 0, levels)
            upper = _hex(row["above"]) + _hex(row["top_above"])
            upper_sides = np.frombuffer(row["side"] + row["top_side"], np.int8).tolist()
            rest, root, out = b"".join(upper), row["root"], []
            for k, claim in enumerate(row["claim"]):
                siblings, sides = segment.path(k)
                leaf = segment.rows[0][k]
                proof = hashlib.sha256(b"".join(siblings) + rest).hexdigest()
                end = folded(leaf if claim is None else claim.encode(), siblings + upper, sides + upper_sides).decode()
                out.append((leaf.decode(), row["subroot"], root, proof, end, end == root))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").flatten(), *columns], ["key", *(x.split()[0] for x in OUT.split(", "))])

    return run


class Manifest:
    """The trees of a table, one per value of `by`, and the tree of their roots. A leaf is H of the record of `fields`.

    `claims`: for rows that are to be checked with other values than stored, the leaf that these give; null for the stored one."""

    def __init__(self, table: DataFrame, by: str, key: str, fields: Sequence[str], claims: Column | None = None, levels: int = LEVELS):
        claim = claims if claims is not None else F.lit(None).cast("string")
        rows = table.select(F.col(by).alias("tree"), F.col(key).alias("key"), digest([F.col(c) for c in fields]).alias("digest"), claim.alias("claim"))
        self.key = key
        self.forest = Forest(rows, ["key", "digest"], ["key", "claim"], levels)
        subroots = self.forest.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
        self.top = Forest(subroots, ["name"], ["name"], levels)

    def root(self) -> str | None:
        """One digest; none of an empty table."""
        row = self.top.roots().first()
        return row["root"] if row else None

    def subroots(self) -> DataFrame:
        """(tree, subroot, root, top_above, top_side): each subroot with its path to the root."""
        levels, root = self.top.levels, self.root()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, row in _rows(batches, "name"):
                segment = _Segment(row, 0, levels)
                above, side = zip(*(_packed(*segment.path(k), row) for k in range(segment.size)), strict=True)
                subroot = pa.array([x.decode() for x in segment.rows[0]])
                columns = [batch.column("name").flatten(), subroot, pa.array([root] * segment.size, pa.string()), pa.array(above, pa.binary()), pa.array(side, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "subroot", "root", "top_above", "top_side"])

        kind = self.top.tiers[0].schema["name"].dataType.elementType.simpleString()
        paths = self.top.proofs().select("name", "block", "leaves", "places", "nodes", "above", "side")
        return paths.mapInArrow(run, f"tree {kind}, subroot string, root string, top_above binary, top_side binary")

    def verified(self) -> DataFrame:
        """Per row: the key, leaf, subroot, root, proof_sha256 (H of the siblings), folded_root and whether that is the root."""
        tops = written(self.subroots(), "manifest-subroots").withColumnRenamed("tree", "_tree")
        blocks = self.forest.proofs().join(tops, F.col("tree").eqNullSafe(F.col("_tree")))
        kind = self.forest.tiers[0].schema["key"].dataType.elementType.simpleString()
        columns = ["key", "block", "leaves", "places", "nodes", "claim", "above", "side", "subroot", "root", "top_above", "top_side"]
        out = blocks.select(*columns).mapInArrow(_verify(self.forest.levels), f"key {kind}, {OUT}")
        return out.withColumnRenamed("key", self.key)
