"""The best-fit decreasing plan, worked out on counts of lengths.

Pieces of one length are alike, so the plan needs only how many there are of each:
at most ``width`` numbers, whatever the corpus. Windows with the same contents are
alike too and are kept as runs of consecutive numbers. A segment tree over the
capacities says which is the smallest with an open window that still fits.
"""

from __future__ import annotations

import numpy as np


class CapacityTree:
    """Which capacities have open windows; finds the smallest one at or above a length."""

    def __init__(self, width: int):
        self.size = 1 << max(1, width.bit_length())
        self.any = np.zeros(2 * self.size, dtype=bool)

    def set(self, capacity: int, present: bool) -> None:
        node = self.size + capacity
        self.any[node] = present
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def at_least(self, capacity: int) -> int | None:
        node = self.size + capacity
        if self.any[node]:
            return capacity
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], width: int) -> tuple[np.ndarray, int]:
    """(steps, windows). A step (length, first, n, window, each, offset) places the pieces ``first`` … ``first + n - 1`` of a length:
    ``each`` of them side by side in each window from ``window`` on, beginning at ``offset``."""
    tree, open_runs, steps, windows = CapacityTree(width), {}, [], 0

    def keep(capacity: int, window: int, n: int) -> None:
        if capacity and n:
            open_runs.setdefault(capacity, []).append((window, n))
            tree.set(capacity, True)

    for length in sorted((k for k, n in counts.items() if n and k), reverse=True):
        first, left = 0, counts[length]
        while left:
            capacity = tree.at_least(length)
            if capacity is None:
                each = width // length
                n = -(-left // each)
                window, capacity = windows, width
                windows += n
            else:
                window, n = open_runs[capacity].pop()
                if not open_runs[capacity]:
                    del open_runs[capacity]
                    tree.set(capacity, False)
                each = capacity // length
            full = min(n, left // each)
            offset = width - capacity
            if full:
                steps.append((length, first, full * each, window, each, offset))
                first, left = first + full * each, left - full * each
                keep(capacity - each * length, window, full)
            if full < n:
                rest = min(left, each)
                if rest:
                    steps.append((length, first, rest, window + full, rest, offset))
                    first, left = first + rest, left - rest
                    keep(capacity - rest * length, window + full, 1)
                    full += 1
                keep(capacity, window + full, n - full)
    return np.array(steps, dtype=np.int64).reshape(-1, 6), windows
