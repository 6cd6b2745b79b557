"""Connected components of a table of links, by contraction.

Each link goes to the end with the smaller hash of this round, so all links of a node meet there if its hash is the smallest among its
neighbours, one after the other; tasks unite the links they hold. A node that several tasks have seen links the roots that it got there. These links are fewer
and between roots only; they are united in the same way, until no node has two roots, and the labels are looked up on the way back. A
node may have any number of links: a large partition is split, as any division of the links gives the same components, a task passes a
node on once, and minima are taken before rows are shuffled. Nothing is collected; what a step leaves is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resamplia.llm.shared import released, stored

# Nodes that a task unites at once; what it holds beyond is united on its own. Any division of the links gives the same components.
NODES = 200_000


def _unite(most: int):
    """(node, root): each node with the smallest that it is linked with here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(parent, kind), pa.array([root(x) for x in parent], kind)], ["node", "root"])

        for batch in batches:
            kind = batch.column("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                if a < b:
                    parent[b] = a
                elif b < a:
                    parent[a] = b
            if len(parent) >= most:
                yield out()
                parent.clear()
        if parent:
            yield out()

    return run


def components(links: DataFrame, most: int = NODES) -> DataFrame:
    """(node, component): the component is its smallest node. Nodes are those of the links `u`, `v`
    (any one comparable type); links of a node to itself or to null say nothing. `most`: nodes that a task unites at once."""
    kind = links.schema["u"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    now, labels = links.filter("u != v").select("u", "v"), []
    while True:
        seed = F.lit(len(labels))
        meet = F.when(F.xxhash64("u", seed) < F.xxhash64("v", seed), F.col("u")).otherwise(F.col("v"))
        dealt = now.withColumn("_meet", meet).hint("rebalance", "_meet").sortWithinPartitions("_meet").drop("_meet")
        found = stored(dealt.mapInArrow(released(_unite(most)), schema))
        least = found.groupBy("node").agg(F.min("root").alias("component"), F.max("root").alias("_most"))
        least = stored(least)
        labels.append(least.select("node", "component"))
        several = least.filter("component != _most").select("node", "component")
        if several.limit(1).count() == 0:
            break
        # Few nodes are seen by several tasks; each gives a link for each further root.
        met = found.join(several, "node").filter("root != component")
        now = stored(met.select(F.col("root").alias("u"), F.col("component").alias("v")).distinct())
    out = labels.pop()
    while labels:
        final = out.select(F.col("node").alias("_node"), F.col("component").alias("_final"))
        below = labels.pop()
        out = below.join(final, below["component"] == F.col("_node"), "left").select("node", F.coalesce("_final", "component").alias("component"))
    return out
