"""Metrics of whole analysis sets as states that merge.

A user's metric says what some weighted rows of a set amount to (`update`), how two such states become one (`merge`), and
what the state of the whole set means (`finish`). No state ever needs a whole set, so sets may be of any size as long as states stay small.
`finish` may ask for another round over the rows (`Ask`), for metrics that need more than one look.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np

Rows = Mapping[str, np.ndarray]


@dataclass(frozen=True)
class Ask:
    """Another round, in which `update` gets `question` for this set."""

    question: Any


class Mergeable(ABC):
    """Whatever makes one state of two. The order must not matter."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any: ...


class SetMetric(Mergeable):
    """`names` are the result columns; all are doubles."""

    names: Sequence[str]

    @abstractmethod
    def update(self, rows: Rows, weight: np.ndarray, question: Any) -> Any:
        """The state of some rows, each drawn `weight` times (1 or more); `question` is None in the first round."""

    def prepare(self, rows: Rows) -> Any:
        """What `weigh` needs of rows that many sets share; None if `update` is to get the drawn rows of each set."""
        return None

    def weigh(self, prepared: Any, weight: np.ndarray, question: Any) -> Any:
        """As `update`, for all rows that were prepared; the weight of a row that is not drawn is 0."""
        raise NotImplementedError

    @abstractmethod
    def finish(self, state: Any, question: Any) -> Mapping[str, float | None] | Ask:
        """Results of a whole set; `state` is None if nothing was drawn."""


class SumMetric(SetMetric):
    """From sums: `parts` gives numbers for some rows, which are added up; `result` makes the metrics of them."""

    def __init__(self, names: Sequence[str], parts: Callable[[Rows, np.ndarray], Sequence[float]], result: Callable[[Sequence[float]], Mapping[str, float | None]]):
        self.names, self.parts, self.result = list(names), parts, result

    def update(self, rows: Rows, weight: np.ndarray, question: Any) -> list[float]:
        return [float(x) for x in self.parts(rows, weight)]

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        return [x + y for x, y in zip(a, b, strict=True)]

    def finish(self, state: list[float] | None, question: Any) -> Mapping[str, float | None]:
        return self.result(state) if state is not None else dict.fromkeys(self.names)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0 counts as 0."""
    bits = (values.astype(np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top != 0, ~bits, bits | top)


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers, none negative, in few bytes: states travel."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values


class QuantileMetric(SetMetric):
    """Exact quantile of a value per row, between neighbours by the usual interpolation; values that are NaN do not count.

    Values are counted by the leading bits of their ordered form. The bits that hold the wanted ranks are asked for again, with
    the next bits, until a prefix holds few draws, which are then counted one by one, or one value only: from the second round on, the
    least and the largest value of a prefix are known. A state has at most 2**BITS counts
    for each of two ranks, whatever the size of the set, and each round narrows ranks by up to 2**BITS.
    """

    BITS, FEW = 16, 4096

    def __init__(self, name: str, value: Callable[[Rows], np.ndarray], q: float = 0.5):
        self.names, self.value, self.q = [name], value, q

    def prepare(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows count, the distinct values in order, and the place of each row among them."""
        values = np.asarray(self.value(rows), np.float64)
        known = ~np.isnan(values)
        return known, *np.unique(_ordered(values[known]), return_inverse=True)

    def weigh(self, prepared: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, question: Any) -> list[tuple[np.ndarray, ...]]:
        known, distinct, place = prepared
        counts = np.bincount(place, weight[known], len(distinct)).astype(np.uint64)
        drawn = np.flatnonzero(counts)
        keys, counts, out = distinct[drawn], counts[drawn], []
        for prefix, bits, more, _ in question or [(0, 0, self.BITS, 0)]:
            low = np.searchsorted(keys, np.uint64(prefix << 64 - bits)) if bits else 0
            high = np.searchsorted(keys, np.uint64((prefix + 1 << 64 - bits) - 1), "right") if bits else len(keys)
            some = keys[low:high] >> np.uint64(64 - bits - more)
            start = np.flatnonzero(np.append(True, some[1:] != some[:-1])) if len(some) else np.empty(0, np.int64)
            total = np.add.reduceat(counts[low:high], start) if len(some) else counts[:0]
            ends = (keys[low:high][start], keys[low:high][np.append(start[1:], len(some)) - 1]) if bits and len(some) else ()
            out.append((_narrow(some[start]), _narrow(total), *ends))
        return out

    def update(self, rows: Rows, weight: np.ndarray, question: Any) -> list[tuple[np.ndarray, ...]]:
        return self.weigh(self.prepare(rows), weight, question)

    def merge(self, a: list, b: list) -> list:
        out = []
        for one, two in zip(a, b, strict=True):
            if not len(one[0]) or not len(two[0]):
                out.append(one if len(one[0]) else two)
                continue
            keys = np.concatenate([one[0], two[0]])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            # Counts, and, if they are known, the least and the largest value.
            parts = zip((np.add, np.minimum, np.maximum), one[1:], two[1:], strict=False)
            joined = [f.reduceat(np.concatenate([x, y]).astype(np.uint64)[order], start) for f, x, y in parts]
            out.append((keys[start], _narrow(joined[0]), *joined[1:]))
        return out

    def finish(self, state: list | None, question: Any) -> Mapping[str, float | None] | Ask:
        name = self.names[0]
        if state is None:
            return {name: None}
        if question is None:
            total = int(state[0][1].astype(np.int64).sum())
            if not total:
                return {name: None}
            low = int((total - 1) * self.q)
            share = (total - 1) * self.q - low
            ranks = [low, min(low + 1, total - 1)] if share else [low]
            state, asked = state * len(ranks), [(0, 0, self.BITS, r) for r in ranks]
        else:
            share, asked = question[0][3][1], [(p, b, m, r[0]) for p, b, m, r in question]
        found, again = [], []
        for (keys, counts, *ends), (_, bits, more, rank) in zip(state, asked, strict=True):
            upto = np.cumsum(counts.astype(np.int64))
            k = int(np.searchsorted(upto, rank, "right"))
            prefix, bits, inside = int(keys[k]), bits + more, rank - int(upto[k] - int(counts[k]))
            if ends and ends[0][k] == ends[1][k]:
                prefix, bits = int(ends[0][k]), 64
            next_bits = 64 - bits if counts[k] <= self.FEW else min(self.BITS, 64 - bits)
            again.append((prefix, bits, next_bits, (inside, share)))
            if bits == 64:
                found.append(_double(prefix))
        if len(found) < len(again):
            # A rank that is known already is asked for with no further bits.
            return Ask(again)
        low, high = found[0], found[-1]
        return {name: low if low == high else low + (high - low) * share}
