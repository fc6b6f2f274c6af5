"""Ids of parts of text, remembered by the parts' hashes and told apart by their bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from mirrorleaf.llm.arrow import Memory, span_hashes

BYTES = 48 << 20  # that the memory of a worker may hold
_LONG = 256  # bytes of a part that is compared on its own


def places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``size`` steps, of all pairs, one after the other."""
    stop = np.cumsum(size, dtype=np.int64)
    return np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; eight more bytes must follow the last place."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class Remembered(Memory):
    """Ids and bytes of parts, each in one pool, found by 64-bit hashes.

    A hash leads to one part. Another part of the same hash is seen by its bytes, and
    encoded each time anew.
    """

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32)  # of the ids
        self.at, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32)  # of the bytes
        self.pool, self.text = np.zeros(0, np.uint32), np.zeros(8, np.uint8)  # eight bytes stand behind the text

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.first, self.size, self.at, self.length, self.pool, self.text))

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> None:
        first = np.cumsum(sizes) - sizes + len(self.pool)
        at = np.cumsum(lengths) - lengths + len(self.text) - 8
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
        self.text = np.concatenate([self.text[:-8], text, self.text[-8:]])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.first, self.size = np.insert(self.first, place, first), np.insert(self.size, place, sizes)
        self.at, self.length = np.insert(self.at, place, at), np.insert(self.length, place, lengths)

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each part has the very bytes of the part that its hash leads to."""
        length = ends - starts
        same = self.length[slot] == length
        at = self.at[slot].astype(np.int64)
        for k in np.flatnonzero(same & (length > _LONG)).tolist():
            same[k] = np.array_equal(data[starts[k] : ends[k]], self.text[at[k] : at[k] + length[k]])
        own, known = eights(np.append(data, np.zeros(8, np.uint8))), eights(self.text)
        live, step = np.flatnonzero(same & (length <= _LONG) & (length > 0)), 0
        while len(live):
            left = length[live] - step
            differ = own[starts[live] + step] ^ known[at[live] + step]
            differ <<= (8 * np.maximum(8 - left, 0)).astype(np.uint64)  # bytes behind the part don't count
            same[live[differ != 0]] = False
            live, step = live[(differ == 0) & (left > 8)], step + 8
        return same

    def ids(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
        encode: Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]],
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, running number of ids after each part, from 0).

        ``encode`` gets the texts of the parts that are new, and which parts they are,
        and gives their ids, one after the other, and the number of ids of each.
        """
        self.touch()
        hashes, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.nbytes() > BYTES:
            self.forget()
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
        raw = data.tobytes()
        texts = lambda where: [raw[s:e].decode() for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        new = np.flatnonzero(~known)
        if len(new):
            where = example[new]
            length = ends[where] - starts[where]
            self._learn(hashes[new], *encode(texts(where), where), data[places(starts[where], length)], length)
        slot = np.searchsorted(self.hashes, hashes)[which]
        size, first, pool = self.size[slot].astype(np.int64), self.first[slot].astype(np.int64), self.pool
        other = np.flatnonzero(~self._same(data, starts, ends, slot))
        if len(other):
            more, sizes = encode(texts(other), other)
            first[other], size[other] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, more.astype(np.uint32)])
        return pool[places(first, size)], np.append(0, np.cumsum(size))
