"""Language-model scores by online logistic mixing of bit predictors.

Tokens are words and one end per text. A token of the training vocabulary is coded by CODE_BITS bits (hashes of its ending
and of the whole word) and then by its share of the tokens with that code; other tokens are
spelled, byte by byte, bit by bit. Each bit has several predictors, whose counts are kept by
hashed contexts: none, the word before, the endings of the two words before, the last non-ASCII letter, and what followed
the last occurrence of the word before in the same text. A gate (the bit's place and how well the last
predictor has done) selects the weights that mix them in the logistic domain; the weights are refined while a
chunk of texts is read, and a last stage corrects the mixture by what was seen at that level. All
that is learned comes from training texts; a training text's own bits are taken out of the counts before
they predict it.

Counts of words grow with the corpus and are never gathered: chunks of texts send theirs, packed, to
the tasks that add them up, and get back the counts of the words they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resamplia.llm.shared import partitions, stored, texts
from resamplia.llm.words import LOWER, NOT_SPACE, find, mix, numbers

CODE_BITS, ENDING_BITS, CONTEXTS = 12, 8, 256
CODES = 1 << CODE_BITS
# Contexts of the spelling: hashes of so many symbols before.
SPELLING = {"spell1": (1, 512), "spell2": (2, 4096), "spell3": (3, 16384), "spell4": (4, 16384)}
SYMBOL_BITS = 9
SYMBOL = (1 << SYMBOL_BITS) - 1
CHUNK_BYTES = 16 << 20
BLOCK = 1 << 15
SLICES, TOGETHER = 64, 32
END = np.uint64(0x0DDBA11C0FFEE5ED)
STATES = 5
PIECE = 1 << 21

TABLES = {name: CONTEXTS * CODES for name in ("before", "endings", "letters")} | {name: size * 257 for name, (_, size) in SPELLING.items()}
SCORES = (
    "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long"
)


class Tokens:
    """Tokens of some texts: hash, code, and what the predictors use (`follow`: also what the last one uses, which is not counted)."""

    def __init__(self, column: pa.Array, follow: bool = True):
        data, offsets = texts(column)
        w = find(data, offsets, NOT_SPACE)
        self.lower = LOWER[data]
        counts = w.counts + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        n = int(self.first[-1])
        at = np.arange(len(w.hash)) + w.text
        self.hash = np.full(n, END)
        self.hash[at] = w.hash
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.start, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[at], self.end[at] = w.start, w.end
        last = np.zeros(n, np.uint64)
        if len(at):
            tail = self.lower[w.end - 1].astype(np.uint64)
            wide = w.end - w.start > 1
            last[at] = tail * np.uint64(257) + np.where(wide, self.lower[np.maximum(w.end - 2, 0)], 0).astype(np.uint64) + np.uint64(1)
        ending = mix(last + np.uint64(77))
        rest = CODE_BITS - ENDING_BITS
        self.code = (((ending >> np.uint64(64 - ENDING_BITS)) << np.uint64(rest)) | (self.hash >> np.uint64(64 - rest))).astype(np.int64)
        begins = np.zeros(n, bool)
        begins[self.first[:-1]] = True
        second = np.zeros(n, bool)
        second[np.minimum(self.first[:-1] + 1, n - 1)] = True
        before = np.concatenate([[END], self.hash[:-1]]) if n else self.hash
        before = np.where(begins, END, before)
        self.before = (mix(before) >> np.uint64(56)).astype(np.int64)
        tail = np.where(begins, 0, np.concatenate([[0], ending[:-1]])) if n else ending
        tail2 = np.where(begins | second, 0, np.concatenate([[0, 0], ending[:-2]])[:n]) if n else ending
        self.endings = (mix(tail.astype(np.uint64) * np.uint64(3) + tail2.astype(np.uint64)) >> np.uint64(56)).astype(np.int64)
        self._letters(data, w, at, begins)
        if follow:
            self._follow(begins)

    def _letters(self, data: np.ndarray, w, at: np.ndarray, begins: np.ndarray) -> None:
        """The last non-ASCII character in the words before: texts of a language or script share few of them."""
        n = len(self.hash)
        places = np.flatnonzero(data >= 0xC0)
        own = np.full(n, -1)
        owner = np.searchsorted(w.start, places, side="right") - 1
        own[at[owner]] = places  # the last one of a word stays
        seen = np.maximum.accumulate(np.concatenate([[-1], np.where(own[:-1] >= 0, np.arange(n - 1), -1)])) if n else own
        seen = np.where(seen >= self.first[:-1][self.text], seen, -1)
        place = np.where(seen >= 0, own[np.maximum(seen, 0)], 0)
        pair = data[place].astype(np.uint64) * np.uint64(256) + data[np.minimum(place + 1, max(len(data) - 1, 0))] if len(data) else place.astype(np.uint64)
        self.letters = np.where(seen >= 0, (mix(pair) >> np.uint64(56)).astype(np.int64), 0)

    def _follow(self, begins: np.ndarray) -> None:
        """What followed the last occurrence of the word before, and how often in a row that was right."""
        n = len(self.hash)
        key = self.hash + numbers(31, int(self.text[-1]) + 1)[self.text] if n else self.hash
        order = np.argsort(key, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = key[order][1:] == key[order][:-1]
        earlier = np.full(n, -1)
        earlier[order[1:]] = np.where(same[1:], order[:-1], -1)
        guess = np.full(n, -1)
        guess[1:] = np.where(begins[1:] | (earlier[:-1] < 0), -1, earlier[:-1] + 1)
        self.guess = np.where(guess >= 0, self.code[np.maximum(guess, 0)], -1)
        right = (guess >= 0) & (self.hash[np.maximum(guess, 0)] == self.hash)
        state = (guess >= 0).astype(np.int64)
        run = np.ones(n, bool)
        for k in (1, 2, 3):
            back = np.zeros(n, bool)
            back[k:] = right[:-k] & (self.text[k:] == self.text[:-k])
            run &= back
            state += run & (guess >= 0)
        self.state = state


def _spelling(lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol (byte + 1, and 0 at the end) of the words: the symbol and those before it as one number, and its word."""
    size = end - start + 1
    total = int(size.sum())
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    at = np.minimum(np.repeat(start, size) + place, max(len(lower) - 1, 0))
    last = place == np.repeat(size, size) - 1
    symbol = np.where(last, 0, lower[at].astype(np.int64) + 1) if total else np.empty(0, np.int64)
    gram = symbol.copy()
    for order, _ in SPELLING.values():
        # The symbol 256 (byte 255) cannot occur in UTF-8, so it marks the beginning.
        gram |= np.where(place >= order, np.roll(symbol, order), 256) << (SYMBOL_BITS * order)
    return gram, word


def _contexts(gram: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The symbols of grams and their contexts."""
    contexts, seen = {}, np.zeros(len(gram), np.uint64)
    for name, (order, slots) in SPELLING.items():
        before = ((gram >> (SYMBOL_BITS * order)) & SYMBOL).astype(np.uint64)
        seen = mix(seen * np.uint64(257) + before + np.uint64(order))
        contexts[name] = (seen % np.uint64(slots)).astype(np.int64)
    return gram & SYMBOL, contexts


def _pieces(table: pa.Table) -> Iterator[pa.Table]:
    sizes = np.array([len(x or "") for x in table.column("text").to_pylist()], np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
    for a, b in zip([0, *cut], [*cut, table.num_rows], strict=True):
        yield table.slice(int(a), int(b - a))


_PACKED = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PACKED = "kind string, part int, chunk int, keys binary, counts binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED) if rows else _PACKED.empty_table()


def _squeeze(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _expand(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _in_order(table: pa.Table) -> pa.Table:
    """The rows by their hashes, so that the same chunk always gives the same figures."""
    names = np.array(table.column("order").to_pylist(), np.int64)
    return table.take(pa.array(np.argsort(names, kind="stable")))


def _count(parts: int):
    """Of one chunk: each distinct token with its training count, packed by part, and slices of the context tables. Spelling
    is learned from the distinct words of the chunk, each once, not from their frequencies."""

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PACKED.empty_table()
        chunk = table.column("chunk")[0].as_py()
        cells: dict[str, list[np.ndarray]] = {name: [] for name in TABLES}
        keys, counts, known = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
        for piece in _pieces(_in_order(table)):
            t = Tokens(piece.column("text"), follow=False)
            train = np.repeat(~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(t.first))
            some, where, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
            own = np.bincount(inverse, weights=train, minlength=len(some)).astype(np.int64)
            code = t.code[train]
            for name, context in (("before", t.before), ("endings", t.endings), ("letters", t.letters)):
                cells[name].append((context[train] * CODES + code).astype(np.int32))
            new = (own > 0) & (some != END)
            if len(known):
                new &= known[np.minimum(np.searchsorted(known, some), len(known) - 1)] != some
            symbol, contexts = _contexts(_spelling(t.lower, t.start[where[new]], t.end[where[new]])[0])
            for name, context in contexts.items():
                cells[name].append((context * 257 + symbol).astype(np.int32))
            known = np.sort(np.concatenate([known, some[new]]))
            merged, inverse = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, own]), minlength=len(merged)).astype(np.int64)
            keys = merged
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        begin = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [("words", p, chunk, keys[order[a:b]].tobytes(), counts[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)) if b > a]
        for name in TABLES:
            total = np.bincount(np.concatenate(cells.pop(name)), minlength=TABLES[name])
            for k, slice_ in enumerate(np.array_split(total, SLICES)):
                rows.append((name, k, chunk, None, _squeeze(slice_)))
        return _rows(rows)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Of one part: the counts of all chunks added up, for each chunk its own words; or a slice of a context table."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    if kind != "words":
        total = sum(_expand(x.as_py(), np.int64) for x in table.column("counts"))
        return _rows([(kind, part, None, None, _squeeze(total))])
    each = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    flat = np.concatenate(each)
    keys, inverse = np.unique(flat, return_inverse=True)
    own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")])
    counts = np.bincount(inverse, weights=own, minlength=len(keys)).astype(np.int64)
    rows, at = [], 0
    for chunk, x in zip(table.column("chunk").to_pylist(), each, strict=True):
        rows.append(("words", part, chunk, x.tobytes(), counts[inverse[at : at + len(x)]].tobytes()))
        at += len(x)
    rows.append(("totals", part, None, None, np.array([counts.sum(), (counts > 0).sum(), (counts == 1).sum()], ">i8").tobytes()))
    return _rows(rows)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


class Mixer:
    """Gated weights, refined block by block, and the correction of the mixture. A gate is a level (the bit's place) and
    a state; all bits of a call have one level."""

    def __init__(self, inputs: int, levels: int, states: int, rate: float = 0.3):
        self.weights = np.full((levels, states, inputs), 1.2 / inputs)
        self.energy = np.full((levels, states, inputs), 50.0)
        self.seen, self.ones = np.full((levels, 33), 4.0), np.full((levels, 33), 4.0) * _squash((np.arange(33) - 16) / 2)
        self.rate = rate

    def bits(self, table: np.ndarray, level: int, gate: np.ndarray, place: np.ndarray, bit: np.ndarray, learn: np.ndarray | None) -> np.ndarray:
        """The probability of each bit, whose inputs are a column of `table`; learns from them by the weights `learn`. `gate` has a 1
        in the row of a bit's state, and `place` is where that 1 is."""
        mixed = np.clip((self.weights[level] @ table).ravel()[place], -14, 14)
        p = 1 / (1 + np.exp(-mixed))
        step = np.clip(np.rint(mixed * 2) + 16, 0, 32).astype(np.int64)
        final = np.clip(0.5 * p + (0.5 * (self.ones[level] / self.seen[level]))[step], 1e-5, 1 - 1e-5)
        if learn is not None:
            slope = table * (learn * (bit - p))
            np.multiply(table, table, out=table)
            table *= learn * p * (1 - p)
            self.energy[level] += gate @ table.T
            self.weights[level] += self.rate * (gate @ slope.T) / self.energy[level]
            both = np.bincount(step * 2 + bit, weights=learn, minlength=66).reshape(33, 2)
            self.seen[level] += both.sum(axis=1)
            self.ones[level] += both[:, 1]
        return np.where(bit > 0, final, 1 - final)


class Cells:
    """Of contexts with counts of codes: the stretched chance of a 1 at each node of the code tree. Three for a node: by all counts, and
    without a text's own 0 or 1."""

    def __init__(self, counts: np.ndarray, width: int):
        self.levels: list[np.ndarray] = []
        nodes = counts.astype(np.float64)
        for _ in range(width.bit_length() - 1):
            zeros, ones = nodes[::2], nodes[1::2]
            chances = np.empty((len(zeros), 3))
            for k, (a, b) in enumerate(((ones, zeros), (ones, np.maximum(zeros - 1, 0)), (np.maximum(ones - 1, 0), zeros))):
                np.log((a + 0.3) / (b + 0.3), out=chances[:, k])
            self.levels.insert(0, chances.ravel())
            nodes = zeros + ones


class Sums:
    """Running sums over symbols within a context, so that any node of the symbol tree is a difference of two."""

    def __init__(self, counts: np.ndarray, width: int):
        rows = counts.reshape(-1, width)
        small = rows.sum(axis=1).max(initial=0) < 1 << 31
        sums = np.zeros((len(rows), width + 1), np.int32 if small else np.int64)
        np.cumsum(rows, axis=1, out=sums[:, 1:])
        self.sums, self.stride = sums.ravel(), width + 1

    def walk(self, context: np.ndarray, own: int, size: int) -> _Walk:
        return _Walk(self.sums, context * self.stride, own, size)


class _Walk:
    def __init__(self, sums: np.ndarray, base: np.ndarray, own: int, size: int):
        self.sums, self.base, self.own = sums, base, own
        self.low, self.high = sums[base], sums[base + size]

    def predict(self, middle: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The stretched chance of a 1, without the text's own bit where `own` is 1."""
        m = self.sums[self.base + middle]
        ones, zeros = self.high - m, m - self.low
        if self.own:
            ones, zeros = ones - bit, zeros - (1 - bit)
        self.low, self.high = np.where(bit > 0, m, self.low), np.where(bit > 0, self.high, m)
        return np.log((ones + 0.3) / (zeros + 0.3))


def new_match() -> np.ndarray:
    """Rights and all guesses of the last predictor, by place and state."""
    return np.stack([np.full((CODE_BITS, STATES), 1.5), np.full((CODE_BITS, STATES), 2.0)])


def _score_codes(t: Tokens, at: np.ndarray, learn: np.ndarray, cells: dict[str, Cells], mixer: Mixer, match: np.ndarray) -> np.ndarray:
    """Log2 probability of the codes of the tokens `at`. match: see new_match."""
    out = np.zeros(len(at))
    for low in range(0, len(at), BLOCK):
        k = at[low : low + BLOCK]
        own = learn[low : low + BLOCK].astype(np.int64)
        weights = own.astype(np.float64) if own.any() else None
        code, guess = t.code[k], t.guess[k]
        n = len(k)
        # Without a guess that is right so far, the state is 0.
        now = np.where(guess >= 0, t.state[k], 0)
        column = np.arange(n)
        place = now * n + column
        gate = np.zeros((STATES, n))
        gate.ravel()[place] = 1
        # Nodes of a level, counted over all contexts.
        nodes = [(cells["none"], np.zeros(n, np.int64)), *((cells[name], getattr(t, name)[k]) for name in ("before", "endings", "letters"))]
        table, chance = np.empty((len(nodes) + 1, n)), np.ones(n)
        for d in range(CODE_BITS):
            shift = CODE_BITS - 1 - d
            bit = (code >> shift) & 1
            kind = own * (1 + bit)
            for row, (c, node) in zip(table, nodes, strict=False):
                np.take(c.levels[d], node * 3 + kind, out=row, mode="clip")
                node += node
                node += bit
            said = (guess >> shift) & 1
            sure = np.log((match[0, d] + 0.5) / (match[1, d] - match[0, d] + 0.5))
            sure[0] = 0
            np.take(np.stack([-sure, sure], axis=1).ravel(), now * 2 + said, out=table[-1], mode="clip")
            chance *= mixer.bits(table, d, gate, place, bit, weights)
            right = said == bit
            if weights is not None:
                found = np.bincount(now * 2 + right, weights=weights, minlength=2 * STATES).reshape(STATES, 2)
                match[0, d, 1:] += found[1:, 1]
                match[1, d, 1:] += found[1:].sum(axis=1)
            lost = np.flatnonzero(~right & (now > 0))
            gate.ravel()[place[lost]] = 0
            gate[0, lost] = 1
            now[lost], place[lost] = 0, lost
        out[low : low + BLOCK] = np.log2(chance)
    return out


def _score_spelling(t: Tokens, at: np.ndarray, cells: dict[str, Sums], mixer: Mixer, learn: bool) -> np.ndarray:
    """Log2 probability of the spelling of the tokens `at`; or learn from them, without their own counts."""
    gram, word = _spelling(t.lower, t.start[at], t.end[at])
    # Equal symbols after equal ones have equal chances; each is looked at once, and counts as often as it occurs.
    gram, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
    symbol, contexts = _contexts(gram)
    n = len(symbol)
    weights = times.astype(np.float64) if learn else None
    # 257 symbols in a tree of 9 bits; the upper part is empty.
    walks = [cells[name].walk(context, int(learn), 257) for name, context in contexts.items()]
    gate, place = np.ones((1, n)), np.arange(n)
    table, node, chance = np.empty((len(walks), n)), np.zeros(n, np.int64), np.ones(n)
    for d in range(SYMBOL_BITS):
        half = np.int64(1) << (SYMBOL_BITS - 1 - d)
        bit = (symbol >> (SYMBOL_BITS - 1 - d)) & 1
        middle = np.minimum(node + half, 257)
        for row, w in zip(table, walks, strict=True):
            row[:] = w.predict(middle, bit)
        chance *= mixer.bits(table, d, gate, place, bit, weights)
        node += half * bit
    return np.bincount(word, weights=np.log2(chance)[inverse], minlength=len(at))


def _score(tables):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64())])
        if not left.num_rows:
            return kinds.empty_table()
        given = tables.value
        if "cells" not in given:  # once per worker
            cells = {}
            for name, size in TABLES.items():
                own = np.concatenate([_expand(x, np.int64) for x in given[name]]) if given[name] else np.zeros(size, np.int64)
                cells[name] = Sums(own, 257) if name in SPELLING else Cells(own, CODES)
                if name == "before":
                    given["by_code"] = own.reshape(-1, CODES).sum(axis=0)
            given["cells"] = cells | {"none": Cells(given["by_code"], CODES)}
        cells, by_code = given["cells"], given["by_code"]
        total, distinct, single = given["totals"]
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in right.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in right.column("counts")])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        # Chance that a token is not in the vocabulary: as often as words were seen once.
        new = (single + 1) / (total + 2)
        mixer, spelling = Mixer(5, CODE_BITS, STATES), Mixer(len(SPELLING), 9, 1)
        match = new_match()
        out = []
        for piece in _pieces(_in_order(left)):
            t = Tokens(piece.column("text"))
            c = counts[np.searchsorted(keys, t.hash)]
            train = np.repeat(~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(t.first))
            known = np.flatnonzero(c > 0)
            logs = np.full(len(c), np.log2(new))
            coded = _score_codes(t, known, train[known], cells, mixer, match)
            logs[known] = np.log2(1 - new) + coded + np.log2(c[known] / np.maximum(by_code[t.code[known]], 1))
            # Words that training has seen once are most like those it has not seen.
            rare = np.flatnonzero((c == 1) & train & (t.hash != END))
            for low in range(0, len(rare), BLOCK):
                _score_spelling(t, rare[low : low + BLOCK], cells, spelling, learn=True)
            unknown = np.flatnonzero(c == 0)
            for low in range(0, len(unknown), BLOCK):
                part = unknown[low : low + BLOCK]
                logs[part] += _score_spelling(t, part, cells, spelling, learn=False)
            base = np.log10((c + 1) / (total + distinct + 1))
            n = len(t.first) - 1
            sizes = np.diff(texts(piece.column("text"))[1])
            out.append(pa.Table.from_arrays([
                piece.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.diff(t.first)), pa.array(np.bincount(t.text, weights=c > 0, minlength=n).astype(np.int64)),
                pa.array(np.full(n, total)), pa.array(np.bincount(t.text, weights=base, minlength=n)), pa.array(np.bincount(t.text, weights=logs, minlength=n) / np.log2(10)), pa.array(sizes),
            ], schema=kinds))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score, bytes.

    `held_out` marks the rows that nothing is learned from (null counts as not held out). base_score is the add-one unigram log10
    probability, score the log10 probability by the mixed model; bits per byte are -score * log2(10) / bytes. Null texts are
    empty: one end token. Equal rows get nearly equal scores (the weights move while a chunk is read). Without
    training texts every token is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    order = F.xxhash64("doc_id", "text")
    dealt = rows.withColumn("order", order).withColumn("chunk", F.pmod(order, F.lit(chunks)).cast("int"))
    parts = max(partitions(spark), chunks)
    counted = dealt.groupBy("chunk").applyInArrow(_count(parts), PACKED)
    # Tables are summed over TOGETHER chunks first, then over these sums.
    level = F.when(F.col("kind") == "words", 0).otherwise(F.expr(f"chunk div {TOGETHER}"))
    added = stored(counted.groupBy("kind", "part", level.alias("level")).applyInArrow(_add_up, PACKED))
    # Context tables have a fixed size; of the words only three totals are fetched.
    tables: dict = {}
    for name in TABLES:
        slices = added.filter(F.col("kind") == name).groupBy("kind", "part").applyInArrow(_add_up, PACKED).select("part", "counts").collect()
        tables[name] = [bytes(r["counts"]) for r in sorted(slices, key=lambda r: r["part"])]
    # Big-endian numbers, which conv can read.
    number = lambda k: F.conv(F.hex(F.substring("counts", 8 * k + 1, 8)), 16, 10).cast("long")
    t = added.filter("kind = 'totals'").agg(*[F.sum(number(k)) for k in range(3)]).first()
    tables["totals"] = np.array([x or 0 for x in t], np.int64)
    words = added.filter("kind = 'words'").select("chunk", "keys", "counts")
    shared = spark.sparkContext.broadcast(tables)
    return dealt.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_score(shared), SCORES)
