"""Words of many texts at once, as numpy arrays.

Texts are laid end to end as UTF-8 with a line break after each. Hashes are polynomials modulo 2^64 with a random odd
base, finished by an invertible mix; equal words and runs of words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

BLOCK = 1 << 18  # bytes that are hashed at once; tables of powers, kept by each worker, are about as long
LETTER_BASE, WORD_BASE = 0x9E6C63D0876A3F6B, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(1 << 12, 1 << int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` entries."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = []
    for i in range(0, len(hashes) - n + 1, BLOCK):
        part = hashes[i:i + BLOCK + n - 1]
        up, down = powers(WORD_BASE, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        out.append(mix((sums[n:] - sums[:-n]) * down[:len(part) - n + 1] + np.uint64(n)))
    return np.concatenate(out)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes that end with a space."""
    inside = np.zeros(len(data) + 1, np.int8)
    np.logical_not(_SPACE[data], out=inside[1:].view(bool))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # blocks of whole words
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        a, b = starts[first], ends[last - 1]
        up, down = powers(LETTER_BASE, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[:b - a], out=sums[1:])
        s, e = starts[first:last] - a, ends[first:last] - a
        hashes[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return starts, ends, hashes


class Texts:
    """Texts laid end to end, with their words; ``bounds[i]:bounds[i + 1]`` are the words of text i."""

    def __init__(self, texts: list[str | bytes | None], lower: bool = False):
        parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join([*parts, b""])
        self.bytes = joined.lower() if lower else joined  # bytes know the letters A-Z only
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
        self.starts, self.stops, self.hashes = words(self.data)
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, self.ends)])
        self.counts = np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def chunks(frames: Iterator, column: str, size: int = 1 << 19) -> Iterator:
    """Data frames of a task, cut so that the texts of each have about ``size`` characters."""
    for frame in frames:
        lengths = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        cuts = np.cumsum(lengths) // size
        for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(cuts)) + 1):
            if len(at):
                yield frame.iloc[at[0]:at[-1] + 1]
