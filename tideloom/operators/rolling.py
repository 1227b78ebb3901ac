"""Sliding windows as machines with a bounded state, for rows that come one after
another. On a static frame the window expressions of ``windows`` are the better
way; these give the same values where no window over past rows can be asked for."""

from __future__ import annotations

from collections import deque

import numpy as np


class Mean:
    """Mean of the last n values: a ring of them. A null empties the window's count for
    as long as it is within, as it does in a window expression."""

    def __init__(self, n: int):
        self.n, self.ring, self.at, self.seen = n, [None] * n, 0, 0

    def push(self, x: np.ndarray) -> np.ndarray:
        out = []
        for v in x.tolist():
            self.ring[self.at] = None if v is None or v != v else v
            self.at, self.seen = (self.at + 1) % self.n, self.seen + 1
            whole = self.seen >= self.n and None not in self.ring
            # summed anew, in order of time: a running total would keep the rounding of all values it has seen
            out.append(sum(self.ring[self.at :] + self.ring[: self.at]) / self.n if whole else np.nan)
        return np.array(out)


class Extreme:
    """Highest (or lowest) of the last n values: places whose value nothing later outdoes."""

    def __init__(self, n: int, highest: bool = True):
        self.n, self.sign, self.queue, self.seen, self.gap = n, 1.0 if highest else -1.0, deque(), 0, -1

    def push(self, x: np.ndarray) -> np.ndarray:
        out = []
        for v in x.tolist():
            if v is None or v != v:
                self.gap = self.seen
            else:
                while self.queue and self.sign * self.queue[-1][1] <= self.sign * v:
                    self.queue.pop()
                self.queue.append((self.seen, v))
            while self.queue and self.queue[0][0] <= self.seen - self.n:
                self.queue.popleft()
            self.seen += 1
            whole = self.seen >= self.n and self.gap < self.seen - self.n
            out.append(self.queue[0][1] if whole else np.nan)
        return np.array(out)
