"""The best documents for each of many items by a sum of term scores, with trees over both sides.

Terms are runs of letters, digits and non-ASCII characters of the whole text, A to Z as a to z, known by 64-bit hashes.
A document's share for a term is an integer (`shares`); its score for an item is the sum over the item's distinct terms.

1. Tasks count terms of items in their documents and write them as chunks of some CHUNK_ENTRIES (document, term) pairs,
   with a tree over the chunk: a node is cut by the term that divides its documents best.
2. Counts of documents and terms, over all chunks, give the weights.
3. Nodes hold, per term, the largest share below them; nodes of the tree over the items hold the terms of their items. The sum
   of a document node's largest shares over an item node's terms bounds the score of every pair below. A pair of nodes goes
   with all that is below it if the bound is less than the k-th best score found so far of each of its items, the weakest of these;
   others are split on both sides, and what reaches the bottom is scored exactly.
4. A first round scores each item's most promising leaf of every chunk, so that the second starts from thresholds
   that real documents reach. Both are k rows for each item and task.

Pruning is strict, so ties are decided by the document's id, whatever the order of work: results are exact. Items come to the tasks
in blocks of some BLOCK_TERMS distinct terms, which bounds what is broadcast and what the driver holds.

Null texts have no terms; documents without terms count in no statistic; items without terms, and items that share no term with
any document, have no rows. Equal items are answered each, equal documents compete each. A null document id comes after all
others among equal scores. Document ids are integers. One document, or one item, is one task's work. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resamplia.llm import words
from resamplia.llm.shared import pieces, texts, written

CHUNK_DOCS, CHUNK_ENTRIES, LEAF_DOCS = 4096, 1 << 18, 32
BLOCK_TERMS = 1 << 18
# Shares that are summed at a time.
SUMMED = 1 << 21
# A node is halved anyhow if no term puts at least this part of its documents on one side.
LEAST_PART = 8


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        found = words.find(*texts(batch.column("_text")), words.LETTER_OR_DIGIT)
        terms = [np.unique(found.hash[a:b]).view(np.int64) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_item"), pa.array(terms, pa.list_(pa.int64()))], ["_item", "terms"])


def _divide(order: np.ndarray, first: np.ndarray, term: np.ndarray, n_terms: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over rows with sorted distinct terms (row i has term[first[i]:first[i + 1]]): the order of the rows, and the places where
    it is cut, with the depth of each cut. The nodes of depth d lie between the cuts of depth d or less."""
    n = len(order)
    row_of = np.repeat(np.arange(n), np.diff(first))
    cuts, depths, depth = np.array([0]), np.array([0]), 0
    while True:
        ends = np.append(cuts[1:], n)
        sizes = ends - cuts
        if not len(order) or sizes.max() <= leaf:
            return order, cuts, depths
        depth += 1
        node = np.empty(n, np.int64)
        node[order] = np.repeat(np.arange(len(cuts)), sizes)
        # The term that the best balanced part of a node has: the largest number of pairs with and without it.
        keys, counts = _counted(node[row_of] * n_terms + term, len(cuts) * n_terms)
        of, part = keys // n_terms, counts * (sizes[keys // n_terms] - counts)
        rank = np.lexsort((keys, -part, of))
        head = rank[np.flatnonzero(np.diff(of[rank], prepend=-1))]
        best, good = np.full(len(cuts), -1), np.zeros(len(cuts), bool)
        best[of[head]] = keys[head] % n_terms
        good[of[head]] = np.minimum(counts[head], sizes[of[head]] - counts[head]) * LEAST_PART >= sizes[of[head]]
        right = np.zeros(n, bool)
        right[row_of[term == best[node[row_of]]]] = True
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(cuts, sizes)
        right = np.where(good[node], right, place >= (sizes[node] + 1) // 2) & (sizes[node] > leaf)
        order = np.lexsort((place, right, node))
        middle = ends - np.bincount(node[right], minlength=len(cuts))
        new = middle[(middle > cuts) & (middle < ends)]
        all_cuts = np.concatenate([cuts, new])
        by = np.argsort(all_cuts, kind="stable")
        cuts, depths = all_cuts[by], np.concatenate([depths, np.full(len(new), depth)])[by]


def _counted(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size <= 1 << 22:
        counts = np.bincount(keys, minlength=size)
        some = np.flatnonzero(counts)
        return some, counts[some]
    return np.unique(keys, return_counts=True)


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the runs of equal values begin and end."""
    cut = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return ([0, *cut], [*cut, len(values)]) if len(values) else ([], [])


def _taken(first: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of the lists `order` are, one list after the other, and where each begins."""
    size = np.diff(first)[order]
    begin = np.zeros(len(order) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    return np.arange(begin[-1]) + np.repeat(first[:-1][order] - begin[:-1], size), begin


_ARRAYS = {"length": np.int64, "first": np.int64, "term": np.int32, "count": np.int32, "cuts": np.int32, "depth": np.int8}
_CHUNK = ", ".join(["n_docs long", "n_terms long", "ids array<long>", *(f"{x} binary" for x in _ARRAYS)])


class _Chunks:
    """Collects documents with their counted terms, and gives chunks."""

    def __init__(self, n_terms: int):
        self.size = n_terms
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.docs = self.entries = self.n_docs = self.n_terms = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """Counted terms sorted by document; documents without any are only counted."""
        self.n_docs += int((lengths > 0).sum())
        self.n_terms += int(lengths.sum())
        per_doc = np.bincount(doc, minlength=len(lengths))
        some = np.flatnonzero(per_doc)
        self.parts.append((ids.take(pa.array(some)), lengths[some], per_doc[some], term, count))
        self.docs += len(some)
        self.entries += len(term)

    def full(self) -> bool:
        return self.docs >= CHUNK_DOCS or self.entries >= CHUNK_ENTRIES

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.parts, strict=True)) or [(), (), (), (), ()]
        ids = pa.concat_arrays(columns[0]) if columns[0] else pa.array([], pa.int64())
        length, per_doc, term, count = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns[1:])
        first = np.append(0, np.cumsum(per_doc)).astype(np.int64)
        order, cuts, depth = _divide(np.arange(len(ids)), first, term, self.size, LEAF_DOCS)
        at, begin = _taken(first, order)
        values = {"length": length[order], "first": begin, "term": term[at], "count": count[at], "cuts": cuts, "depth": depth}
        # Packed here, so that a task's rows take in memory what they take in the file.
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pa.array([pack(values[x].astype(t).tobytes())], pa.binary()) for x, t in _ARRAYS.items()]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        row = [pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64()), lists, *blobs]
        self.clear()
        return pa.RecordBatch.from_arrays(row, [x.split()[0] for x in _CHUNK.split(", ")])


def _chunk_rows(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        chunks = _Chunks(len(known))
        for batch in pieces(batches, "_text"):
            found = words.find(*texts(batch.column("_text")), words.LETTER_OR_DIGIT)
            place = np.minimum(np.searchsorted(known, found.hash), len(known) - 1)
            hit = np.flatnonzero(known[place] == found.hash)
            keys, counts = np.unique(found.text[hit] * len(known) + place[hit], return_counts=True)
            chunks.add(batch.column("_doc"), found.counts, keys // len(known), keys % len(known), counts)
            if chunks.full():
                yield chunks.take()
        yield chunks.take()

    return run


def _frequencies(n_terms: int):
    """Documents per term, summed over the chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for blob in batch.column("term"):
                total += np.bincount(_array(blob.as_py(), "term"), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    return run


def _array(blob: bytes, name: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), _ARRAYS[name])


def shares(weight: np.ndarray, count: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of a document that holds it `count` times among its `length` terms."""
    m = 100 - 90 + (90 * length * n_docs) // n_terms
    return weight * ((1000000000 * count) // (1000 * count + 8 * m))


def weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in frequency.tolist()], np.int64)


@dataclass
class _Items:
    """A block of items: their terms, in the order of the tree over them, and the cuts of that tree."""

    first: np.ndarray
    term: np.ndarray
    cuts: np.ndarray
    depth: np.ndarray
    weight: np.ndarray
    n_docs: int
    n_terms: int
    k: int

    def levels(self, local: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of every level of the tree: where its nodes begin, and the lists of the distinct terms below them, by local numbers (a
        term without one is left out)."""
        own, item = local[self.term], np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        item, own = item[own >= 0], own[own >= 0]
        size, out = int(local.max(initial=0)) + 1, []
        for d in range(int(self.depth.max(initial=0)) + 1):
            starts = self.cuts[self.depth <= d]
            keys = np.unique((np.searchsorted(starts, item, "right") - 1) * size + own)
            out.append((starts, np.searchsorted(keys, np.arange(len(starts) + 1) * size), keys % size))
        return out


class _Best:
    """The k best documents of each item so far. Sorted by item, score (largest first) and id (null last)."""

    def __init__(self, n_items: int, k: int, threshold: np.ndarray | None = None):
        self.k, self.item = k, np.empty(0, np.int64)
        self.score, self.doc, self.null = self.item, self.item, np.empty(0, bool)
        self.start = np.ones(n_items, np.int64) if threshold is None else np.maximum(threshold, 1)
        self.threshold = self.start.copy()

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        begin = np.searchsorted(item[order], np.arange(len(self.start)))
        keep = order[np.arange(len(order)) - begin[item[order]] < self.k]
        self.item, self.score, self.doc, self.null = item[keep], score[keep], doc[keep], null[keep]
        last = np.flatnonzero(np.bincount(self.item, minlength=len(self.start)) >= self.k)
        weakest = self.score[np.searchsorted(self.item, last) + self.k - 1]
        self.threshold[last] = np.maximum(self.start[last], weakest)

    def rows(self) -> pa.RecordBatch:
        columns = [pa.array(self.item), pa.array(self.doc, mask=self.null), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(columns, ["item", "doc", "score"])


class _Chunk:
    """A chunk with its trees: shares, and largest shares of the leaves, by local term numbers."""

    def __init__(self, row: dict, items: _Items):
        length, first, term, count, cuts, self.depth = (_array(row[x], x) for x in _ARRAYS)
        self.null = np.array([x is None for x in row["ids"]], bool)
        self.ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        self.first, self.cuts = first, cuts.astype(np.int64)
        self.share = shares(items.weight[term], count.astype(np.int64), np.repeat(length, np.diff(first)), items.n_docs, items.n_terms)
        present, self.term = np.unique(term, return_inverse=True)
        self.width = len(present)
        local = np.full(len(items.weight), -1)
        local[present] = np.arange(len(present))
        self.items = items.levels(local)
        doc = np.repeat(np.arange(len(length)), np.diff(first))
        keys = (np.searchsorted(self.cuts, doc, "right") - 1) * self.width + self.term
        order = np.argsort(keys, kind="stable")
        some, begin = np.unique(keys[order], return_index=True)
        largest = np.zeros(len(self.cuts) * self.width, np.int64)
        largest[some] = np.maximum.reduceat(self.share[order], begin)
        self.largest = largest.reshape(len(self.cuts), self.width)

    def bounds(self, largest: np.ndarray, node: np.ndarray, first: np.ndarray, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of each pair of a document node and an item node, the sum of largest shares."""
        out = [np.empty(0, np.int64)]
        parts = np.cumsum(np.diff(first)[item]) // SUMMED
        for a, b in zip(*_runs(parts), strict=True):
            at, begin = _taken(first, item[a:b])
            sums = np.append(0, np.cumsum(largest[np.repeat(node[a:b], np.diff(begin)), term[at]]))
            out.append(sums[begin[1:]] - sums[begin[:-1]])
        return np.concatenate(out)

    def promising(self) -> tuple[np.ndarray, np.ndarray]:
        """For each item, the leaf of the largest bound."""
        _, first, term = self.items[-1]
        n = len(first) - 1
        best, leaf = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(len(self.cuts)):
            bound = self.bounds(self.largest, np.full(n, k), first, term, np.arange(n))
            better = bound > best
            best[better], leaf[better] = bound[better], k
        item = np.flatnonzero(best)
        return leaf[item], item

    def open_pairs(self, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (leaf, item) pairs that no bound on the way down from the two roots has excluded."""
        depths = max(int(self.depth.max(initial=0)) + 1, len(self.items))
        node, item = np.zeros(1, np.int64), np.zeros(1, np.int64)
        starts, groups = self.cuts[:1], self.items[0][0][:1]
        for d in range(depths):
            # Children of the nodes that are left, on both sides.
            new = self.cuts[self.depth <= d]
            new_groups, first, term = self.items[min(d, len(self.items) - 1)]
            node, item = _children(starts, new, len(self.ids), node, item)
            item, node = _children(groups, new_groups, len(threshold), item, node)
            starts, groups = new, new_groups
            largest = self.largest if len(new) == len(self.cuts) else np.maximum.reduceat(self.largest, np.searchsorted(self.cuts, new), axis=0)
            weakest = np.minimum.reduceat(threshold, new_groups)
            keep = self.bounds(largest, node, first, term, item) >= weakest[item]
            node, item = node[keep], item[keep]
        return node, item

    def score(self, leaf: np.ndarray, item: np.ndarray, best: _Best) -> None:
        """Exact scores of all documents of the leaves for the items they are paired with. There are no pairs if the bounds exclude the
        whole chunk."""
        _, first, term = self.items[-1]
        order = np.argsort(leaf, kind="stable")
        leaves, begin = np.unique(leaf[order], return_index=True)
        begin = np.append(begin, len(order))
        ends = np.append(self.cuts[1:], len(self.ids))
        found = []
        for k, a, b in zip(leaves.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            docs = np.arange(self.cuts[k], ends[k])
            table = np.zeros((len(docs), self.width), np.int64)
            inside = slice(self.first[docs[0]], self.first[docs[-1] + 1])
            table[np.repeat(docs - docs[0], np.diff(self.first)[docs]), self.term[inside]] = self.share[inside]
            own = item[order[a:b]]
            at, starts = _taken(first, own)
            scores = np.add.reduceat(table[:, term[at]], starts[:-1], axis=1)
            d, q = np.nonzero(scores >= best.threshold[own])
            found.append((own[q], scores[d, q], docs[d]))
        if found:
            of, score, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            best.add(of, score, self.ids[doc], self.null[doc])


def _children(starts: np.ndarray, new: np.ndarray, end: int, node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the finer nodes in `node` with what these were paired with."""
    edges = np.searchsorted(new, np.append(starts, end))
    size = (edges[1:] - edges[:-1])[node]
    begin = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(edges[:-1][node] - begin, size), np.repeat(other, size)


def _answers(items, threshold, whole: bool):
    """The best of each item over a task's chunks; not whole: only of its most promising leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        best = _Best(len(own.first) - 1, own.k, threshold.value if threshold else None)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["ids"]:
                    chunk = _Chunk(row, own)
                    chunk.score(*(chunk.open_pairs(best.threshold) if whole else chunk.promising()), best)
        yield best.rows()

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, numbers: np.ndarray, lists: list[np.ndarray], k: int) -> DataFrame:
    """(item, rank, doc, score) for the items `numbers` with the hashed terms `lists`."""
    context = docs.sparkSession.sparkContext
    vocabulary = np.unique(np.concatenate(lists))
    first = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    term = np.searchsorted(vocabulary, np.concatenate(lists))
    order, cuts, depth = _divide(np.arange(len(lists)), first, term, len(vocabulary), 1)
    at, begin = _taken(first, order)
    index = written(docs.mapInArrow(_chunk_rows(context.broadcast(vocabulary)), _CHUNK), "ranked-index")
    total = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = total["d"] or 0, total["t"] or 0
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in index.select("term").mapInArrow(_frequencies(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[row["term"]] = row["n"]
    items = context.broadcast(_Items(begin, term[at], cuts, depth, weights(frequency, n_docs), n_docs, max(n_terms, 1), k))
    schema = "item long, doc long, score long"
    threshold = np.ones(len(lists), np.int64)
    for row in _top(index.mapInArrow(_answers(items, None, whole=False), schema), k).filter(F.col("rank") == k).select("item", "score").collect():
        threshold[row["item"]] = row["score"]
    found = _top(index.mapInArrow(_answers(items, context.broadcast(threshold), whole=True), schema), k)
    names = docs.sparkSession.createDataFrame(pa.table({"item": np.arange(len(lists)), "_item": numbers[order]}))
    return found.join(names, "item").select("_item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, best first, ties to the smaller id."""
    spark = docs.sparkSession
    known = written(items.select(items[item_id].alias("_name"), items[text].alias("_text")).withColumn("_item", F.monotonically_increasing_id()), "ranked-items")
    lists = written(known.select("_item", "_text").mapInArrow(_term_rows, "_item long, terms array<long>").filter(F.size("terms") > 0), "ranked-terms")
    blocks = -(-(lists.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) // BLOCK_TERMS)
    own = docs.select(docs[doc_id].cast("long").alias("_doc"), docs[text].alias("_text"))
    out = spark.createDataFrame([], "_item long, rank int, doc long, score long")
    for b in range(blocks):
        part = lists.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).orderBy("_item").toArrow()
        if part.num_rows:
            terms = [np.array(x, np.int64).view(np.uint64) for x in part["terms"].to_pylist()]
            out = out.unionByName(_search_block(own, part["_item"].to_numpy(), terms, k))
    named = out.join(known.select("_item", "_name"), "_item")
    return named.select(F.col("_name").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
