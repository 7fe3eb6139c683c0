"""Orders side by side: row ``i`` of every order as one vector.

A batch holds many orders of unequal lengths, one after another.  Most of what is done
with them needs no order at all, and much of the rest is a running sum or maximum that
starts anew with each order; ``Lanes`` has both over the whole batch.  A recurrence is
stepped: step ``i`` takes row ``i`` of all orders that have one.  Once fewer than
``LEAST_LANES`` orders are left, vectors are no longer worth their overhead, and the rest of
each order runs by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Orders from which on a step over all of them is faster than a loop over the rows of each.
LEAST_LANES = 6


class Lanes:
    """Where orders start and end in a batch, and their rows by step."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.rows = int(self.ends[-1]) if len(self.ends) else 0
        self.of_row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self._steps = None

    def __len__(self) -> int:
        return len(self.lengths)

    def since(self, marks: np.ndarray) -> np.ndarray:
        """The latest marked row of the same order up to each row, or -1."""
        latest = np.maximum.accumulate(np.where(marks, np.arange(self.rows), -1))
        return np.where(latest >= self.starts[self.of_row], latest, -1)

    def before(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each row's predecessor, ``first`` at an order's start."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def running_sums(self, values: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """Sums of whole numbers within each order, from what is carried in."""
        sums = np.cumsum(values, dtype=np.int64)
        return sums + (carried - (sums[self.starts] - values[self.starts]))[self.of_row]

    def _by_step(self) -> tuple[np.ndarray, np.ndarray, list[int], int]:
        """Orders from long to short, rows step by step, each step's number of orders, and the steps taken together."""
        if self._steps is None:
            ranked = np.argsort(-self.lengths, kind="stable")
            longest = self.lengths[ranked]
            steps = int(longest[LEAST_LANES - 1]) if len(longest) >= LEAST_LANES else 0
            counts = np.searchsorted(-longest, -np.arange(steps), side="left")
            firsts = np.repeat(np.cumsum(counts) - counts, counts)
            step = np.repeat(np.arange(steps), counts)
            rows = self.starts[ranked[np.arange(len(step)) - firsts]] + step
            self._steps = ranked, rows, counts.tolist(), steps
        return self._steps

    def steps(self, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The columns' values of each step, orders from long to short; see ``ranked`` and ``collected``."""
        _, rows, counts, _ = self._by_step()
        turned = [c[rows] for c in columns]
        at = 0
        for n in counts:
            yield tuple(c[at:at + n] for c in turned)
            at += n

    @property
    def ranked(self) -> np.ndarray:
        """Orders from long to short, as their rows come in ``steps``."""
        return self._by_step()[0]

    def collected(self, parts: list[np.ndarray], dtype) -> np.ndarray:
        """What the steps gave, row by row of the batch; rows that no step had are left to ``rest``."""
        out = np.empty(self.rows, dtype)
        if parts:
            out[self._by_step()[1]] = np.concatenate(parts)
        return out

    def rest(self) -> Iterator[tuple[int, slice]]:
        """Orders with rows behind the last common step: their rank, and these rows."""
        ranked, _, _, steps = self._by_step()
        for rank, lane in enumerate(ranked.tolist()):
            if self.lengths[lane] <= steps:
                return
            yield rank, slice(int(self.starts[lane]) + steps, int(self.ends[lane]))
