"""Suffix sort by hash comparison: prefix hashes, binary search for common extensions, mergesort.

Two suffixes are compared by the longest common extension, found by binary search over lengths with
polynomial prefix hashes, and by the byte after it. The mergesort works on many small groups at once:
each round merges neighbouring runs of every group by finding, for all entries together, how many of the
other run stand before them. Common extensions of neighbours are then counted again on the bytes; a group
in which that disagrees with the hashes is sorted on its bytes.
"""

from __future__ import annotations

import numpy as np

from newsweave.llm.exchange import byte_values, powers, prefix_sums


class Suffixes:
    """Entries at ``at`` with ``size`` bytes in a buffer, compared with each other."""

    def __init__(self, buffer: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.buffer = np.append(buffer, np.uint8(0))
        self.at, self.size = at.astype(np.int64), size.astype(np.int64)
        self.powers = powers(len(buffer) + 1)
        self.sums = prefix_sums(byte_values()[buffer], self.powers)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of entries x and y."""
        a, b = self.at[x], self.at[y]
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.size[x], self.size[y])
        pa, pb, sa, sb = self.powers[a], self.powers[b], self.sums[a], self.sums[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.sums[a + middle] - sa) * pb == (self.sums[b + middle] - sb) * pa
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether entry x sorts before entry y (or level with it, where asked for)."""
        n = self.common(x, y)
        sx, sy = self.size[x], self.size[y]
        ended = n == np.minimum(sx, sy)
        cx, cy = self.buffer[self.at[x] + np.where(ended, 0, n)], self.buffer[self.at[y] + np.where(ended, 0, n)]
        return np.where(ended, (sx < sy) | (or_equal & (sx == sy)), cx < cy)

    def sort(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order within groups (given by first slot and count), and common bytes with the entry before."""
        order = np.arange(len(self.at))
        group = np.repeat(np.arange(len(first)), count)
        width = 1
        while width < count.max(initial=0):
            slots = np.flatnonzero(count[group] > width)
            start, total = first[group[slots]], count[group[slots]]
            inner = slots - start
            pair, right = inner // (2 * width), (inner // width) % 2 == 1
            begin = start + pair * 2 * width
            low = np.where(right, begin, begin + width)
            high = np.minimum(np.where(right, begin + width, begin + 2 * width), start + total)
            low = np.minimum(low, high)
            base = low.copy()
            own = np.where(right, inner - pair * 2 * width - width, inner - pair * 2 * width)
            while (live := np.flatnonzero(low < high)).size:
                middle = (low[live] + high[live]) >> 1
                ahead = self.before(order[middle], order[slots[live]], right[live])
                low[live] = np.where(ahead, middle + 1, low[live])
                high[live] = np.where(ahead, high[live], middle)
            merged = order.copy()
            merged[begin + own + (low - base)] = order[slots]
            order = merged
            width *= 2
        shared, wrong = self._verified(order, group)
        for g in np.unique(group[wrong]):
            here = order[first[g] : first[g] + count[g]]
            order[first[g] : first[g] + count[g]] = sorted(here, key=lambda e: self.buffer[self.at[e] : self.at[e] + self.size[e]].tobytes())
        if wrong.size:
            shared, _ = self._verified(order, group)
        return order, shared

    def _verified(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common bytes of neighbours, counted on the bytes, and slots where the hashes said otherwise."""
        shared = np.zeros(len(order), dtype=np.int64)
        wrong = []
        for at in range(1, len(order), 1 << 15):
            slots = np.arange(at, min(at + (1 << 15), len(order)))
            slots = slots[group[slots] == group[slots - 1]]
            if not slots.size:
                continue
            x, y = order[slots - 1], order[slots]
            most = np.minimum(self.size[x], self.size[y])
            reach = np.arange(int(most.max(initial=0)))
            last = len(self.buffer) - 1
            differ = self.buffer[np.minimum(self.at[x][:, None] + reach, last)] != self.buffer[np.minimum(self.at[y][:, None] + reach, last)]
            differ |= reach >= most[:, None]
            shared[slots] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
            wrong.append(slots[shared[slots] != self.common(x, y)])
        return shared, np.concatenate(wrong) if wrong else np.zeros(0, dtype=np.int64)
