"""Words and word windows of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``. Its hash is a
polynomial over random 64-bit values of its bytes, taken from one running sum
over the joined texts, then mixed; all arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix generator: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def seeds(n: int, stream: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values of a numbered stream."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(stream * 1_000_003)) * U(_BASE))


_VALUES = seeds(256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers 0 to n - 1; kept between calls up to a chunk's length."""
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, U(base & (2**64 - 1)), dtype=U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > 8_000_000:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class Words:
    """The words of a list of texts. ``doc``: each word's text; ``counts``: words of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate((np.zeros(1, dtype=edge.dtype), edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lengths)))
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(self.counts)))
        self.lower = lower

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self._ranges(self.starts, self.ends, self.lower)

    def hash_ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hashes that the bytes from ``starts`` to ``ends``, A-Z lower-cased, have as words."""
        return self._ranges(starts, ends, True)

    def _ranges(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        up, down = _grown(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            values = _VALUES[_LOWER[self.raw] if lower else self.raw]
            values *= up[: len(values)]
            total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(values, dtype=U)))
            found = (total[ends] - total[starts]) * down[starts]
            return mix(found + (ends - starts).astype(U))


def weights(k: int) -> np.ndarray:
    """By how much a word's hash counts at each place of a window of ``k`` words, before the sum is mixed."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate((np.ones(1, dtype=U), np.full(k - 1, _WINDOW))))[::-1]


def windows(hashes: np.ndarray, doc: np.ndarray, k: int, mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``k`` words inside one text; with ``mixed`` false the sum that ``mix(sum + k)`` makes the hash."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        total = hashes[:n].copy()
        for j in range(1, k):
            total = total * _WINDOW + hashes[j : j + n]
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return (mix(total[at] + U(k)) if mixed else total[at]), at


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash of a whole short sequence of word hashes; differs from every window of another length."""
    with np.errstate(over="ignore"):
        total = hashes[:1].copy()
        for j in range(1, len(hashes)):
            total = total * _WINDOW + hashes[j : j + 1]
        return int(mix(total + U(len(hashes)))[0])
