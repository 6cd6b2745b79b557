"""A mergeable summary of many numbers that encloses their quantiles, with an error that it knows itself."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from resamplia.functions.states import Mergeable


@dataclass
class Sketch:
    """Sorted buffers; a number in buffer k stands for 2**k numbers.

    A buffer of `size` numbers is halved when it is full: every second one moves up. The number of values below any x changes
    by at most 2**k then, and `error` is the sum of these. With n numbers it is some n * log2(n / size) / size; it holds for any
    order of values and merges. There are no random choices.
    """

    size: int
    buffers: list[np.ndarray] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)
    n: int = 0
    error: int = 0
    least: float = np.inf
    largest: float = -np.inf

    def add(self, values: np.ndarray) -> Sketch:
        values = np.asarray(values, np.float64)
        values = values[~np.isnan(values)]
        for at in range(0, len(values), self.size):
            part = values[at : at + self.size]
            self.n += len(part)
            self.least, self.largest = min(self.least, part.min()), max(self.largest, part.max())
            self._put(0, part)
            self._settle()
        return self

    def merge(self, other: Sketch) -> Sketch:
        self.n, self.error = self.n + other.n, self.error + other.error
        self.least, self.largest = min(self.least, other.least), max(self.largest, other.largest)
        for k, buffer in enumerate(other.buffers):
            self._put(k, buffer)
        self._settle()
        return self

    def _put(self, k: int, values: np.ndarray) -> None:
        while len(self.buffers) <= k:
            self.buffers.append(np.empty(0))
            self.turns.append(0)
        self.buffers[k] = np.sort(np.concatenate([self.buffers[k], values]))

    def _settle(self) -> None:
        k = 0
        while k < len(self.buffers):
            full = self.buffers[k]
            if len(full) >= self.size:
                even = len(full) // 2 * 2
                self.buffers[k] = full[even:]
                self._put(k + 1, full[self.turns[k] : even : 2])
                self.turns[k] ^= 1  # first the one, then the other of each two: errors tend to cancel
                self.error += 1 << k
            k += 1

    def bounds(self, q: float) -> tuple[float, float] | None:
        """Two numbers that enclose the exact quantile (between neighbours by interpolation); None without numbers."""
        if not self.n:
            return None
        values = np.concatenate(self.buffers)
        weights = np.concatenate([np.full(len(b), 1 << k, np.int64) for k, b in enumerate(self.buffers)])
        distinct, place = np.unique(values, return_inverse=True)
        upto = np.cumsum(np.bincount(place, weights, len(distinct)).astype(np.int64))
        below = np.append(0, upto[:-1])
        rank = (self.n - 1) * q
        sure_low = np.flatnonzero(below + self.error <= int(np.floor(rank)))
        sure_high = np.flatnonzero(upto - self.error >= int(np.ceil(rank)) + 1)
        low = distinct[sure_low[-1]] if len(sure_low) else self.least
        high = distinct[sure_high[0]] if len(sure_high) else self.largest
        return float(low), float(high)


class SketchMerge(Mergeable):
    def merge(self, a: Sketch, b: Sketch) -> Sketch:
        return a.merge(b)
