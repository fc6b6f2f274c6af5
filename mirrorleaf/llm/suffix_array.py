"""A suffix array over a sequence of word hashes, and searches in it, all in numpy."""

from __future__ import annotations

import numpy as np

KEY_BITS = 63


class SuffixArray:
    """Suffixes of the words of several texts, sorted by their first ``depth`` words.

    Word ranks are packed, mostly three to a key, for the first sort; then prefix
    doubling sorts on, among equal suffixes only. No suffix reaches beyond its text: a text's
    end is less than any word.
    """

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, depth: int):
        self.vocabulary, rank = np.unique(hashes, return_inverse=True)
        self.bits = max(KEY_BITS // 3, len(self.vocabulary).bit_length())
        self.pack = KEY_BITS // self.bits  # words in a key
        n = len(hashes)
        # a stop of rank 0 stands behind each text, at position n here; words have ranks from 1
        rank = (rank + 1).astype(np.int64)
        self.n, self.depth = n, max(depth, self.pack)
        ends = np.repeat(offsets[1:], np.diff(offsets))  # where the text of a position ends
        self.ends = ends
        at = np.arange(n)
        key = rank << ((self.pack - 1) * self.bits)
        for k in range(1, self.pack):
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - k)] = rank[k:]
            ahead[at + k >= ends] = 0
            key |= ahead << ((self.pack - 1 - k) * self.bits)
        self.key = key  # of each position
        order = np.argsort(key, kind="stable")
        group = self._groups(key[order])
        place = np.empty(n, np.int64)  # position -> first place of its group
        place[order] = group
        span = self.pack
        while span < self.depth and n:
            tied = np.flatnonzero(self._tied(group))
            if not len(tied):
                break
            where = order[tied]
            ahead = where + span
            inside = ahead < ends[where]
            following = np.zeros(len(where), np.int64)
            following[inside] = place[ahead[inside]] + 1
            new = np.lexsort((following, group[tied]))
            order[tied] = where[new]
            old, following = group[tied][new], following[new]
            change = np.ones(len(tied), bool)
            change[1:] = (old[1:] != old[:-1]) | (following[1:] != following[:-1])
            group[tied] = tied[np.maximum.accumulate(np.where(change, np.arange(len(tied)), 0))]
            place[order[tied]] = group[tied]
            span *= 2
        self.order = order
        self.sorted_key = key[order]

    @staticmethod
    def _groups(keys: np.ndarray) -> np.ndarray:
        change = np.ones(len(keys), bool)
        change[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(change, np.arange(len(keys)), 0)) if len(keys) else keys

    @staticmethod
    def _tied(group: np.ndarray) -> np.ndarray:
        same = np.zeros(len(group), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        return same

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, or -1 where the texts don't have it."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def find(self, ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places [low, high) in the array whose suffixes begin with each query.

        ``ranks`` has a row for each query, of which the first ``lengths`` words count;
        no length exceeds ``depth``.
        """
        q = len(ranks)
        low, high = np.zeros(q, np.int64), np.zeros(q, np.int64)
        width = ranks.shape[1]
        known = ((ranks >= 0) | (np.arange(width) >= lengths[:, None])).all(axis=1)
        # packed keys of the query, and the mask of the bits that count in each
        levels = -(-width // self.pack)
        keys = np.zeros((q, levels), np.int64)
        masks = np.zeros((q, levels), np.int64)
        for j in range(width):
            counts = j < lengths
            shift = (self.pack - 1 - j % self.pack) * self.bits
            keys[:, j // self.pack] |= np.where(counts, np.maximum(ranks[:, j], 0) << shift, 0)
            masks[:, j // self.pack] |= np.where(counts, ((1 << self.bits) - 1) << shift, 0)
        low[:] = np.searchsorted(self.sorted_key, keys[:, 0], "left")
        high[:] = np.searchsorted(self.sorted_key, keys[:, 0] | ~masks[:, 0] & ((1 << self.pack * self.bits) - 1), "right")
        high[~known] = low[~known]
        live = np.flatnonzero((low < high) & (lengths > self.pack))
        if len(live):
            first = self._bound(keys[live], masks[live], lengths[live], low[live], high[live], False)
            last = self._bound(keys[live], masks[live], lengths[live], low[live], high[live], True)
            low[live], high[live] = first, last
        return low, high

    def _bound(self, keys, masks, lengths, low, high, after: bool) -> np.ndarray:
        """Binary search of all queries at once for the first place that is not less (or greater)."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            where = self.order[middle]
            sign = np.zeros(len(open_), np.int8)  # of suffix against query
            for level in range(keys.shape[1]):
                undecided = np.flatnonzero((sign == 0) & (lengths[open_] > level * self.pack))
                if not len(undecided):
                    break
                at = where[undecided] + level * self.pack
                inside = at < self.ends[where[undecided]]
                own = np.where(inside, self.key[np.minimum(at, self.n - 1)], 0) & masks[open_[undecided], level]
                other = keys[open_[undecided], level]
                sign[undecided] = (own > other).astype(np.int8) - (own < other).astype(np.int8)
            right = sign <= 0 if after else sign < 0
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
