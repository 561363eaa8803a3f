"""64-bit hashes of words and of word windows, computed on whole buffers of UTF-8 text at once.

Every hash is a pure function of the bytes: the same on each executor, in each run and on recomputed tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BUFFER = 1 << 20  # bytes hashed at once; a longer text is hashed alone

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of the ordered pair."""
    return mix(mix(left + np.uint64(0x632BE59BD9B4E019)) * np.uint64(3) + right)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * BUFFER:
            _powers[base] = have
    return have[:n]


def windows(values: np.ndarray, first: np.ndarray, length: np.ndarray | int, base: int = _BASE) -> np.ndarray:
    """Hash of values[first : first + length] for each first, in time linear in all values."""
    if not len(first):
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    found = (total[first + length] - total[first]) * powers(inverse, len(values))[first]
    return mix(found + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(texts: Sequence[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > begin and size + n > BUFFER:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each whitespace-separated word, and for each text where its words begin (one more entry for the end)."""
    data = b"\n".join(x or b"" for x in texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(x or b"") + 1 for x in texts])
    offsets = np.concatenate([[0], np.searchsorted(begin, ends)])
    return windows(raw.astype(np.uint64) + np.uint64(1), begin, end - begin), offsets
