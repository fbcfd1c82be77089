"""A vectorised index of words, for vocabularies that grow with what a worker meets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordIndex:
    """Numbers words in the order of their addition, and finds them again: an open hash table whose calls take arrays."""

    _byte = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
    _power = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.hashes, self.slots = np.zeros(0, np.uint64), np.full(1 << 12, -1, np.int32)

    def __len__(self) -> int:
        return len(self.words)

    @classmethod
    def hash(cls, words: pa.Array) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(words):
            return np.zeros(0, np.uint64)
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(cls._byte.take(data) * cls._power.take(place, mode="wrap"), out=total[1:])
        return total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, or -1, and its hash. ``words`` are large strings without nulls."""
        hashes = self.hash(words)
        out = np.full(len(hashes), -1, np.int64)
        at, rows = self._first(hashes), np.arange(len(hashes))
        while len(rows):
            found = self.slots.take(at)
            rows, at, found = (x[found >= 0] for x in (rows, at, found))
            same = self.hashes.take(found) == hashes.take(rows)
            out[rows[same]] = found[same]
            rows, at = rows[~same], at[~same] + 1 & len(self.slots) - 1
        known = np.flatnonzero(out >= 0)
        same = pc.equal(words.take(pa.array(known)), self.words.take(pa.array(out[known]))).to_numpy(zero_copy_only=False)
        out[known[~same]] = -1  # another word of this hash
        return out, hashes

    def add(self, words: pa.Array, hashes: np.ndarray) -> None:
        """Numbers more words, which ``find`` has not found."""
        first = len(self.hashes)
        self.words, self.hashes = pa.concat_arrays([self.words, words]), np.concatenate([self.hashes, hashes])
        if 2 * len(self.hashes) > len(self.slots):
            self.slots, first = np.full(1 << (4 * len(self.hashes)).bit_length() - 1, -1, np.int32), 0
        number = np.arange(first, len(self.hashes), dtype=np.int32)
        at = self._first(self.hashes[first:])
        while len(number):
            free = self.slots.take(at) < 0
            self.slots[at[free]] = number[free]
            left = self.slots.take(at) != number
            number, at = number[left], at[left] + 1 & len(self.slots) - 1

    def only(self, kept: np.ndarray) -> WordIndex:
        """The same of the words that ``kept`` marks, numbered anew."""
        out = WordIndex()
        out.add(self.words.filter(pa.array(kept)), self.hashes[kept])
        return out
