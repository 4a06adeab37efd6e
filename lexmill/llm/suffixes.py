"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified (S: smaller than the next suffix, L: larger), the
leftmost S ones of each run (LMS) are sorted by their substrings, and all
others are induced from them in two linear scans. A scan goes bucket by bucket
(first byte); a bucket's entries are handled as a batch, entries that fall into
the same bucket again form the next batch, which is the order of the classical
scan. Where LMS substrings repeat, their names form a string of their own whose
suffixes are sorted next; its alphabet is large, so this level doubles ranks
instead of scanning buckets.
"""

from __future__ import annotations

import numpy as np

from lexmill.llm.bytescan import prefix_hash, range_hash


def _rank_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet."""
    rank, n, k = names.astype(np.int64), len(names), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class _Inducer:
    def __init__(self, text: np.ndarray) -> None:
        self.text, n = text, len(text)
        step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
        at = np.where(np.append(step, -1) != 0, np.arange(n), n)
        following = np.minimum.accumulate(at[::-1])[::-1]
        self.small = np.append(step, -1)[following] > 0  # S type
        lms = np.zeros(n, bool)
        lms[1:] = self.small[1:] & ~self.small[:-1]
        self.lms = np.flatnonzero(lms)
        self.is_lms = lms

    @staticmethod
    def _deal(lists: list[list[np.ndarray]], where: np.ndarray, byte: np.ndarray) -> None:
        """Append places to the lists of their bytes, in order."""
        if not len(where):
            return
        order = np.argsort(byte, kind="stable")
        where, byte = where[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part, b in zip(np.split(where, cuts), byte[np.concatenate([[0], cuts])].tolist(), strict=True):
            lists[b].append(part)

    def induce(self, lms_order: np.ndarray) -> np.ndarray:
        """The suffix array that this order of the LMS suffixes induces."""
        text, small, n = self.text, self.small, len(self.text)
        seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
        self._deal(seeds, lms_order, text[lms_order])
        large: list[list[np.ndarray]] = [[] for _ in range(256)]
        large[int(text[n - 1])].append(np.array([n - 1], np.int32))  # from the end of the text
        for c in range(256):
            batches, wave = [], np.concatenate(large[c]) if large[c] else None
            while wave is not None and len(wave):
                batches.append(wave)
                before = wave[wave > 0] - 1
                before = before[~small[before]]
                byte = text[before]
                self._deal(large, before[byte != c], byte[byte != c])
                wave = before[byte == c]
            large[c] = batches
            if seeds[c]:
                before = np.concatenate(seeds[c]) - 1
                self._deal(large, before, text[before])
        tiny: list[list[np.ndarray]] = [[] for _ in range(256)]
        for c in range(255, -1, -1):
            batches, wave = [], np.concatenate(tiny[c]) if tiny[c] else None
            while wave is not None and len(wave):
                batches.append(wave)
                before = wave[wave > 0] - 1
                before = before[small[before]]
                byte = text[before]
                self._deal(tiny, before[byte != c], byte[byte != c])
                wave = before[byte == c]
            tiny[c] = batches
            if large[c]:
                wave = np.concatenate(large[c])[::-1]
                before = wave[wave > 0] - 1
                before = before[small[before]]
                self._deal(tiny, before, text[before])
        parts = []
        for c in range(256):
            parts += large[c]
            if tiny[c]:
                parts.append(np.concatenate(tiny[c])[::-1])
        return np.concatenate(parts)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a byte string in ascending order; the end counts as smallest."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    x = _Inducer(text)
    lms = x.lms.astype(np.int32)
    if len(lms) > 1:
        first = x.induce(lms)
        order = first[x.is_lms[first]]
        running = prefix_hash(text)
        end = np.append(lms[1:] + 1, n).astype(np.int64)  # a substring ends with the next LMS place
        place = np.zeros(n, np.int32)
        place[lms] = np.arange(len(lms))
        k = place[order]
        h, size = range_hash(running, lms.astype(np.int64), end)[k], (end - lms)[k]
        fresh = (h[1:] != h[:-1]) | (size[1:] != size[:-1])
        fresh |= (k[1:] == len(lms) - 1) | (k[:-1] == len(lms) - 1)  # the last one meets the end
        names = np.concatenate([[0], np.cumsum(fresh)])
        if names[-1] < len(lms) - 1:
            by_place = np.empty(len(lms), np.int64)
            by_place[k] = names
            lms = lms[_rank_doubling(by_place)]
        else:
            lms = order
    return x.induce(lms)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the common prefix with its predecessor in the suffix array, and that predecessor (-1: none).

    Only places whose preceding byte differs from the predecessor's are compared, by
    bisection on hashes up to `most`; elsewhere the value is one less than at the place before.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    jump = (i == 0) | (before <= 0)
    jump[1:] |= text[i[1:] - 1] != text[before[1:] - 1]
    where = np.flatnonzero(jump & (before >= 0))
    other = before[where]
    low, high = np.zeros(len(where), np.int64), np.minimum(n - np.maximum(where, other), most)
    running = prefix_hash(text)
    while (todo := np.flatnonzero(low < high)).size:
        mid = (low[todo] + high[todo] + 1) // 2
        a, b = where[todo], other[todo]
        same = range_hash(running, a, a + mid) == range_hash(running, b, b + mid)
        low[todo] = np.where(same, mid, low[todo])
        high[todo] = np.where(same, high[todo], mid - 1)
    out = np.zeros(n, np.int64)
    out[where] = low
    last = np.maximum.accumulate(np.where(jump, i, -1))
    return np.maximum(np.where(before >= 0, out[last] - (i - last), 0), 0), before


def repeated(text: np.ndarray, size: int, most: int) -> np.ndarray:
    """Whether the `size` bytes at each place start anywhere else too."""
    sa = suffix_array(text)
    lcp, before = permuted_lcp(text, sa, most)
    with_before = lcp >= size
    out = with_before.copy()
    out[before[with_before]] = True
    return out
