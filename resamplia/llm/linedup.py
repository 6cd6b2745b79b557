"""Fuzzy deduplication of lines: of all lines that are alike, one occurrence stays.

Lines are compared without regard to case of A-Z and to white space; equal lines are one. A line's set is that of its
character shingles. MinHash signatures are cut into bands, and lines with an equal band
meet in a list. Each member is compared exactly with the most central member of its lists; what is
alike is united; members of a list that are still apart are then compared with one another,
block against block, exactly. One occurrence per component stays, the first by doc_id.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resamplia.llm.components import components
from resamplia.llm.postings import best_centres, few_pairs, key_filter, may_be_key, open_blocks, open_lists, postings, repeated
from resamplia.llm.shared import forget, partitions, pieces, released, stored, tidy, written
from resamplia.llm.words import LOWER, mix, numbers

# Bytes of text whose shingles a task holds at once.
PIECE = 1 << 20
# Bytes of text whose shingles are hashed at once.
CACHED = 1 << 16
# Characters of a shingle; least similarity. 9 bands of 4 miss a pair at 0.8 once in 120, at 0.9 once in 15,000.
SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS = 9, 4
BLOCK = 1024
# Shingles, and pairs, of a block that are in a table at once.
COLUMNS, PAIRS = 512, 1 << 16
# Lists of up to so many lines are compared together with others.
AT_ONCE = 64
# Lines go to their groups in packed rows: the values of many lines, one after the other, in each column.
PACKED = "rid binary, keys binary, first binary, copies binary"
# Bytes of lines that a task packs at once, lines of a merged row, bytes of a line's id and of its first place.
HELD, TOGETHER, ID, PLACE = 1 << 23, 2048, 16, 29
# Lists of up to so many lines are compared pair by pair, longer ones in blocks.
FEW = 6
# A pair that is just similar enough agrees in so few of the minima once in some 10,000.
SIGMAS = 4


def normal(line: bytes) -> bytes:
    """White space and case are those of ASCII."""
    return b" ".join(line.split())


def line_id(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def doc_key(doc_id: int | None, text: bytes) -> bytes:
    return hashlib.md5(f"{doc_id}\0".encode() + text).digest()


def place_key(doc_id: int | None, doc: bytes, line: int) -> bytes:
    """A place in the order in which places stay: by doc_id, null last, by doc, by line."""
    return struct.pack(">?Q16sI", doc_id is None, (doc_id or 0) + (1 << 63), doc, line)


_WHITE = b" \t\r\x0b\x0c"
# Small letters, and blanks for other white space within a line.
_LOWER = LOWER.tobytes().translate(bytes.maketrans(b"\t\r\x0b\x0c", b"    "))


def shingle_hashes(lines: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n characters of each line (of the whole line if it is shorter), and where each line begins."""
    texts = [x.decode() for x in lines]
    lengths = np.array([len(x) for x in texts])
    # Each line is followed by n characters that are not looked at by its runs, or end a shorter line.
    pad = "\0" * n
    points = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le"), np.uint32).astype(np.uint64)
    runs = np.zeros(len(points), np.uint64)
    for k, factor in enumerate(numbers(21, n) | np.uint64(1)):
        runs[: len(points) - k] += points[k:] * factor
    counts = np.maximum(lengths - n + 1, 1)
    begin = np.cumsum(counts) - counts
    start = np.cumsum(lengths + n) - lengths - n
    return mix(runs[np.arange(counts.sum()) + np.repeat(start - begin, counts)]), begin


def short_hashes(lines: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """As `shingle_hashes`, in 32 bits: enough for minima, which are checked afterwards."""
    pad = b"\0" * n
    text = pad.join(lines) + pad
    if text.isascii():
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        points = np.frombuffer(text, np.uint8).astype(np.uint32)
    else:
        lengths = np.array([len(x.decode()) for x in lines])
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    runs = np.zeros(len(points), np.uint32)
    product = np.empty_like(runs)
    for k, factor in enumerate((numbers(21, n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)):
        runs[: len(points) - k] += np.multiply(points[k:], factor, out=product[k:])
    counts = np.maximum(lengths - n + 1, 1)
    start = np.cumsum(lengths + n) - lengths - n
    edges = np.zeros(len(points) + 1, np.int8)
    edges[start] = 1
    edges[start + counts] = -1
    x = runs[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    other = product[: len(x)]
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= np.right_shift(x, np.uint32(shift), out=other)
        x *= np.uint32(factor)
    x ^= np.right_shift(x, np.uint32(16), out=other)
    return x, np.cumsum(counts) - counts


def band_keys(lines: list[bytes], n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of each line, and a byte of each minimum."""
    factors = (numbers(22, bands * rows) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = np.empty((bands * rows, len(lines)), np.uint32)
    # So few lines at a time that their hashes stay in the processor's cache while they are multiplied again and again.
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    cuts = (np.flatnonzero(np.diff(ends // CACHED)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True):
        short, begin = short_hashes(lines[a:b], n)
        product = np.empty_like(short)
        for k, factor in enumerate(factors):
            np.minimum.reduceat(np.multiply(short, factor, out=product), begin, out=least[k, a:b])
    out = np.zeros((bands, len(lines)), np.uint64)
    for k in range(bands * rows):
        out[k // rows] = mix(out[k // rows] + least[k] + np.uint64(k + 1))
    return np.ascontiguousarray(out.T), np.ascontiguousarray(((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T)


def least_matches(minima: int, similarity: float) -> int:
    return max(1, math.floor(similarity * minima - SIGMAS * math.sqrt(similarity * (1 - similarity) * minima)))


def shingle_set(line: bytes, n: int) -> set[str]:
    text = line.decode()
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


class Sets:
    """Shingle sets of some lines. Eight characters of Latin-1 are eight bytes, so the shingles of lines that it can write are numbers,
    read off these bytes, and a set is a sorted array; other lines have sets of texts, and `pair` gives two sets of the same kind."""

    def __init__(self, lines: list[bytes], n: int):
        self.lines, self.n = lines, n
        own = [self._latin(x) if n == 8 else None for x in lines]
        data = b"".join(x for x in own if x)
        self.size = [len(x) if x else 0 for x in own]
        self.begin = (np.cumsum(self.size) - self.size).tolist() if lines else []
        self.numbers = np.ndarray(len(data) - 7, np.uint64, data, strides=1) if len(data) > 7 else None
        self.known: dict[int, np.ndarray | None] = {}

    @staticmethod
    def _latin(line: bytes) -> bytes | None:
        if line.isascii():
            return line
        try:
            return line.decode().encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _numbers(self, i: int) -> np.ndarray | None:
        if self.size[i] < 8:
            return None
        runs = np.sort(self.numbers[self.begin[i] : self.begin[i] + self.size[i] - 7])
        new = np.ones(len(runs), bool)
        np.not_equal(runs[1:], runs[:-1], out=new[1:])
        return runs[new]

    def of(self, i: int, keep: bool) -> np.ndarray | None:
        if not keep:
            return self._numbers(i)
        if i not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            self.known[i] = self._numbers(i)
        return self.known[i]

    def pair(self, i: int, j: int, keep: bool = True) -> tuple[set, set] | tuple[np.ndarray, np.ndarray]:
        """The sets of two lines; `keep`: that of the first is likely to be asked for again, as that of the second always is."""
        x, y = self.of(i, keep), self.of(j, True)
        if x is None or y is None:
            return shingle_set(self.lines[i], self.n), shingle_set(self.lines[j], self.n)
        return x, y


def alike(x: set | np.ndarray, y: set | np.ndarray, similarity: float) -> bool:
    """Two sets of texts, or two sorted arrays without repeats."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    if isinstance(x, set):
        both = len(x & y)
    else:
        merged = np.concatenate([x, y])
        merged.sort()
        both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both >= similarity * (len(x) + len(y) - both)


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, int, bytes]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        if text:
            doc = doc_key(doc_id, text)
            # As `normal`, for all lines at once.
            text = text.translate(_LOWER)
            while b"  " in text:
                text = text.replace(b"  ", b" ")
            for k, raw in enumerate(text.split(b"\n")):
                line = raw.strip(b" ")
                if line:
                    yield doc_id, doc, k, line


def _scan(n: int, bands: int, rows: int):
    """Each distinct line of a batch with its bands and its first occurrence there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches, "text", PIECE):
            # The first occurrence, and how many there are.
            first: dict[bytes, list] = {}
            for doc_id, doc, k, line in _lines(batch):
                seen = first.get(line)
                if seen is None:
                    first[line] = [doc_id is None, doc_id, doc, k, 1]
                    continue
                seen[4] += 1
                if (doc_id is None, doc_id or 0, doc, k) < (seen[0], seen[1] or 0, seen[2], seen[3]):
                    seen[:4] = doc_id is None, doc_id, doc, k
            if not first:
                continue
            lines = list(first)
            keys, _ = band_keys(lines, n, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(line_id, lines), pa.binary()), _rows_of(keys), pa.array([place_key(*x[1:4]) for x in first.values()], pa.binary()), pa.array([x[4] for x in first.values()], pa.int64())],
                ["rid", "keys", "first", "copies"],
            )

    return run


def _unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The bytes of each value; a row holds one or several."""
    parts = [np.empty(0, np.uint8)]
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(x):
            offsets = np.frombuffer(x.buffers()[1], np.int32)
            parts.append(np.frombuffer(x.buffers()[2], np.uint8)[offsets[x.offset] : offsets[x.offset + len(x)]])
    return (parts[1] if len(parts) == 2 else np.concatenate(parts)).reshape(-1, width)


def _deal(scan, groups: int, bands: int):
    """What `scan` finds, packed: a row for each group that has lines, whose number follows from their ids."""

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        group = columns[0].view(np.uint64)[:, 1] % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        some, begin = np.unique(group[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(_rows_of(x[order], begin) for x in columns)], ["g", "rid", "keys", "first", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in scan(batches):
            held.append([_unpacked(batch.column(c), width) for c, width in (("rid", ID), ("keys", 8 * bands), ("first", PLACE))])
            held[-1].append(batch.column("copies").to_numpy().view(np.uint8).reshape(-1, 8))
            size += batch.nbytes
            if size >= HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _merge(bands: int):
    """The distinct lines of a group with their first places and how many there are, packed."""

    def run(table: pa.Table) -> pa.Table:
        rid, keys, first, copies = (_unpacked(table.column(c), width) for c, width in (("rid", ID), ("keys", 8 * bands), ("first", PLACE), ("copies", 8)))
        high, low = rid.view(np.uint64).T
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(copies.view(np.int64).ravel()[order], begin)
        sizes = np.diff([*begin, len(order)])
        one, least = order[begin], order[begin]
        # Places are compared as bytes, where a line has several.
        line = np.repeat(np.arange(len(begin)), sizes)
        several = (sizes > 1)[line]
        line, rows = line[several], order[several]
        if len(rows):
            places = np.zeros((len(rows), 32), np.uint8)
            places[:, :PLACE] = first[rows]
            sorted_places = np.lexsort((*places.view(">u8").astype(np.uint64).T[::-1], line))
            names, at = np.unique(line[sorted_places], return_index=True)
            least[names] = rows[sorted_places[at]]
        starts = np.arange(0, len(one), TOGETHER)
        return pa.table([_rows_of(x, starts) for x in (rid[one], keys[one], first[least], total.view(np.uint8).reshape(-1, 8))], ["rid", "keys", "first", "copies"])

    return run


def _occurrences(bits=None):
    """Of packed lines a row for each that occurs again or may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, first = _unpacked(batch.column("rid"), ID), _unpacked(batch.column("first"), PLACE)
            copies = _unpacked(batch.column("copies"), 8).view(np.int64).ravel()
            wanted = copies > 1
            if bits is not None:
                wanted |= may_be_key(bits.value[0], rid.view(np.uint64)[:, 0])
            yield pa.RecordBatch.from_arrays([_rows_of(rid[wanted]), _rows_of(first[wanted]), pa.array(copies[wanted])], ["rid", "first", "copies"])

    return run


def _rows_of(table: np.ndarray, begin: np.ndarray | None = None) -> pa.Array:
    """The bytes of each row, or of the rows from each of `begin` to the next one together."""
    width = table.shape[1] * table.itemsize
    offsets = (np.arange(len(table) + 1) if begin is None else np.append(begin, len(table))).astype(np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(table))])


def _lists(keys: np.ndarray, bands: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) // bands + 1, dtype=np.int32) * np.int32(bands)), pa.array(keys))


def _bands(n: int, bands: int, rows: int):
    """Lines with the keys of their bands and a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words", PIECE):
            keys, codes = band_keys(batch.column("words").to_pylist(), n, bands, rows)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("words"), _lists(keys.view(np.int64).ravel(), bands), _rows_of(codes)], ["rid", "words", "keys", "codes"])

    return run


def _chosen(bits):
    """All places of the lines that may be in the second filter; if they may be in the first, at the first place in a batch also the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = list(_lines(batch))
            ids = [line_id(x[3]) for x in found]
            keys = np.frombuffer(b"".join(i[:8] for i in ids), np.uint64) if ids else np.empty(0, np.uint64)
            rows, seen = [], set()
            hit = np.flatnonzero(may_be_key(bits.value[1], keys))
            for i, listed in zip(hit.tolist(), may_be_key(bits.value[0], keys[hit]).tolist(), strict=True):
                rows.append((ids[i], found[i][1], found[i][2], found[i][3] if listed and ids[i] not in seen else None))
                seen.add(ids[i])
            if rows:
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "doc", "line", "words"])

    return run


def _collide(least: int):
    """The pairs that agree in enough minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("u_codes", "v_codes"))
                keep = pa.array((a == b).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return run


def _confirm(n: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("u_words").to_pylist(), batch.column("v_words").to_pylist()
            place: dict[bytes, int] = {}
            second = [place.setdefault(x, len(place)) for x in right]
            sets = Sets([*place, *left], n)
            keep = [alike(*sets.pair(len(place) + i, j, keep=False), similarity) for i, j in enumerate(second)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return run


def _common(lines: list[bytes], left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of shingles that the lines of two blocks have in common, by one product of tables, and of each line."""
    hashes, begin = shingle_hashes(lines, n)
    row = np.repeat(np.arange(len(lines)), np.diff([*begin, len(hashes)]))
    names, code = np.unique(hashes, return_inverse=True)
    both = np.unique(row * len(names) + code)
    row, code = both // len(names), both % len(names)
    size = np.bincount(row, minlength=len(lines))
    shared = (np.bincount(code, minlength=len(names)) > 1)[code]  # the others cannot be common
    row, code = row[shared], code[shared]
    _, column = np.unique(code, return_inverse=True)
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        part = (column >= low) & (column < low + COLUMNS)
        flags = np.zeros((len(lines), COLUMNS), np.float32)
        flags[row[part], column[part] - low] = 1
        common += flags[left] @ flags[right].T
    return common, size


def _compare(n: int, similarity: float, least: int, bands: int):
    """Links within a block of a list or between two: pairs of different components that agree in enough minima
    are compared exactly, one by one or, if they are many, all at once. A pair that meets in several lists is looked at in
    the first. No more links than unite what they connect are returned."""
    kinds = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_pylist()
        names, comp = np.unique(np.array([x.hex() for x in table.column("component").to_pylist()]), return_inverse=True)
        own = table.column("own").to_numpy()
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        left = np.flatnonzero(own == a)
        right = left if a == b else np.flatnonzero(own == b)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rid), bands)
        here = int(np.flatnonzero((keys == table.column("key")[0].as_py()).any(axis=0))[0])
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(rid), -1)
        us, vs = [], []
        for i in left:
            others = right[right > i] if a == b else right
            others = others[comp[others] != comp[i]]
            same = keys[others] == keys[i]
            good = ((codes[others] == codes[i]).sum(axis=1) >= least) & (same.argmax(axis=1) == here)
            us.append(np.full(good.sum(), i, np.int32))
            vs.append(others[good].astype(np.int32))
        u, v = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (us, vs))
        del us, vs
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out: list[tuple[bytes, bytes]] = []
        words = table.column("words").to_pylist()
        if len(u) > 20 * len(rid):
            common, size = _common(words, left, right, n)
            place = np.zeros(len(rid), int)
            place[right] = np.arange(len(right))
            row = np.zeros(len(rid), int)
            row[left] = np.arange(len(left))
            near = np.empty(len(u), bool)
            for k in range(0, len(u), PAIRS):
                x, y = u[k : k + PAIRS], v[k : k + PAIRS]
                both = common[row[x], place[y]]
                near[k : k + PAIRS] = both >= similarity * (size[x] + size[y] - both)
            u, v = u[near], v[near]
        sets: dict[int, set[str]] = {}
        for i, j in zip(u.tolist(), v.tolist(), strict=True):
            x, y = root(comp[i]), root(comp[j])
            if x == y:
                continue
            for m in (i, j):
                if m not in sets:
                    sets[m] = shingle_set(words[m], n)
            if alike(sets[i], sets[j], similarity):
                parent[x] = y
                out.append((rid[i], rid[j]))
        return pa.Table.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], schema=kinds)

    return run


def _sets_at_once(n: int, similarity: float, least: int, bands: int):
    """`_compare` over the groups of a partition, which come one after the other: short ones many at a time."""
    single, names = _compare(n, similarity, least, bands), ["key", "a", "b"]

    def small(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Groups of one block each."""
        rid, words = table.column("rid").to_pylist(), table.column("words").to_pylist()
        parts = table.column("component").to_pylist()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rid), bands)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(rid), -1)
        number = {x: k for k, x in enumerate(dict.fromkeys(parts))}
        comp = np.array([number[x] for x in parts])
        group = np.repeat(np.arange(len(starts)), sizes)
        here = np.logical_or.reduceat(keys == table.column("key").to_numpy()[:, None], starts).argmax(axis=1)
        corner = {s: np.triu_indices(s, 1) for s in set(sizes.tolist())}
        u = np.concatenate([a + corner[s][0] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)])
        v = np.concatenate([a + corner[s][1] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)])
        apart = comp[u] != comp[v]
        u, v = u[apart], v[apart]
        good = (codes[u] == codes[v]).sum(axis=1) >= least
        u, v = u[good], v[good]
        good = (keys[u] == keys[v]).argmax(axis=1) == here[group[u]]
        parent = list(range(len(number)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = Sets(words, n)
        out: list[tuple[bytes, bytes]] = []
        for i, j in zip(u[good].tolist(), v[good].tolist(), strict=True):
            x, y = root(comp[i]), root(comp[j])
            if x == y:
                continue
            if alike(*sets.pair(i, j), similarity):
                parent[x] = y
                out.append((rid[i], rid[j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["u", "v"])

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Some complete groups."""
        changes = np.zeros(table.num_rows, bool)
        changes[0] = True
        for c in names:
            x = table.column(c).to_numpy()
            changes[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(changes)
        sizes = np.diff([*starts, table.num_rows])
        alone = (sizes > AT_ONCE) | (table.column("a").to_numpy() != table.column("b").to_numpy())[starts]
        for a, size in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True):
            yield from single(table.slice(a, size)).to_batches()
        few = np.repeat(~alone, sizes)
        if few.any():
            own = sizes[~alone]
            yield from small(table.filter(pa.array(few)), np.cumsum(own) - own, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group may go on in the next batch.
            last = np.ones(batch.num_rows, bool)
            for c in names:
                x = batch.column(c).to_numpy()
                last &= x == x[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if rest and (cut or any(rest[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in names)):
                same = all(rest[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in names)
                yield from whole(pa.Table.from_batches([*rest, batch.slice(0, cut)] if same else rest))
                if not same and cut:
                    yield from whole(pa.Table.from_batches([batch.slice(0, cut)]))
                rest = [batch.slice(cut)]
            else:
                if cut:
                    yield from whole(pa.Table.from_batches([batch.slice(0, cut)]))
                rest.append(batch.slice(cut))
        if rest:
            yield from whole(pa.Table.from_batches(rest))

    return run


def line_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Distinct lines that occur again or have a line alike: rid, component, and the place that stays (kept_doc,
    kept_line); and the places (rid, doc, line) of these and some other lines."""
    with tidy(docs.sparkSession):  # many steps, whose shuffle files need not wait for each other
        return _line_components(docs, shingle, similarity, bands, rows)


def _line_components(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    least = least_matches(bands * rows, similarity)
    # As many groups as tasks and more, so that a group is small.
    dealt = _deal(_scan(shingle, bands, rows), 2 * partitions(spark), bands)
    scan = texts.mapInArrow(released(dealt), f"g int, {PACKED}")
    reps = written(scan.groupBy("g").applyInArrow(_merge(bands), PACKED), "lines")
    total = (reps.agg(F.sum(F.octet_length("rid"))).first()[0] or 0) // ID
    keys = stored(repeated(reps, "keys", total * bands))
    lists = postings(reps, "rid", "keys", keys, ID)
    weights = lists.groupBy("rid").agg(F.sum("n").alias("weight"), F.collect_list("key").alias("keys"))
    entries = stored(weights.select("rid", "weight", F.explode("keys").alias("key")))
    best = stored(best_centres(entries))

    # Places of the lines that are in some list or occur again, and texts of the former.
    wanted = entries.select("rid").distinct()
    occurrences = "rid binary, first binary, copies long"
    again = reps.select("rid", "first", "copies").mapInArrow(_occurrences(), occurrences)
    listed = key_filter(wanted.select(_little("rid")))
    bits = spark.sparkContext.broadcast((listed, listed | key_filter(again.select(_little("rid")))))
    places = written(texts.mapInArrow(released(_chosen(bits)), "rid binary, doc binary, line int, words binary"), "lines")
    words = places.filter("words is not null").select("rid", "words").dropDuplicates(["rid"]).join(wanted, "rid", "left_semi")
    # Only these lines are compared; their bands are made again, which is less than to shuffle those of all lines.
    known = written(words.mapInArrow(released(_bands(shingle, bands, rows)), "rid binary, words binary, keys array<long>, codes binary"), "lines")

    def of(side: str, name: str) -> DataFrame:
        return known.select(F.col("rid").alias(side), F.col(name).alias(f"{side}_{name}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.join(of("u", "codes"), "u").join(of("v", "codes"), "v").mapInArrow(_collide(least), "u binary, v binary")
        return met.join(of("u", "words"), "u").join(of("v", "words"), "v").mapInArrow(released(_confirm(shingle, similarity)), "u binary, v binary")

    links = stored(confirmed(best))
    united = components(links)
    lists = stored(open_lists(entries, united))
    few = few_pairs(lists, FEW).join(best, ["u", "v"], "left_anti").join(best.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")
    dealt = open_blocks(lists.filter(F.col("n") > FEW), BLOCK).join(known, "rid")
    groups = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    found = groups.mapInArrow(released(_sets_at_once(shingle, similarity, least, bands)), "u binary, v binary")
    more = stored(confirmed(few).unionByName(found))
    final = components(united.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    some = reps.select("rid", "first", "copies").mapInArrow(released(_occurrences(bits)), occurrences)
    labelled = some.join(final.select(F.col("node").alias("rid"), "component"), "rid", "left").filter("copies > 1 or component is not null")
    labelled = stored(labelled.select("rid", F.coalesce("component", "rid").alias("component"), "first"))
    kept = labelled.groupBy("component").agg(F.min("first").alias("k"))
    line = F.conv(F.hex(F.substring("k", 26, 4)), 16, 10).cast("int")
    stays = labelled.join(kept, "component").select("rid", "component", F.substring("k", 10, 16).alias("kept_doc"), line.alias("kept_line"))
    return stays, places.select("rid", "doc", "line")


def _little(rid: str):
    high = F.hex(F.substring(rid, 1, 8))
    swapped = F.concat(*[F.substring(high, k, 2) for k in range(15, 0, -2)])
    # Only the low bits are used by the filter.
    return F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long").alias("key")


def _rebuild(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out, lines, gone = [], [], []
            for text, removed in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_removed").to_pylist(), strict=True):
                parts = [] if text is None else text.split(b"\n")
                drop = set(removed or ())
                out.append(text if text is None or not drop else b"\n".join(x for k, x in enumerate(parts) if k not in drop))
                lines.append(sum(1 for x in parts if x.strip(_WHITE)))
                gone.append(len(drop))
            columns = [pa.array(out, pa.binary()).cast(batch.column("text").type) if c == "text" and any(gone) else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the lines of which an alike one stays elsewhere, and the columns n_lines (lines that are not blank) and n_removed
    (in place of such columns that it may have). All rows stay, and so do blank lines.

    The occurrence that stays is the first by doc_id (null last), then by a hash of the document, then by line. Rows that
    repeat a doc_id and text are one document and give equal rows. Null texts stay null.
    """
    docs = docs.drop("n_lines", "n_removed")
    found, places = line_components(docs, **options)
    gone = places.join(found, "rid").filter("not (doc = kept_doc and line = kept_line)").groupBy("doc").agg(F.collect_set("line").alias("_removed"))
    plain = F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))
    key = F.unhex(F.md5(F.concat(plain, F.lit("\0"), F.col("text")).cast("binary")))
    joined = docs.withColumn("_doc", key).join(gone.withColumnRenamed("doc", "_gone"), F.col("_doc") == F.col("_gone"), "left").drop("_doc", "_gone")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(released(_rebuild(names)), schema)
