"""Words and window hashes of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than space and \\x09-\\x0D of the UTF-8
text, which is the same as the regex [^\\x20\\x09-\\x0D]+ on its characters.
Hashes are polynomials modulo 2^64 over mixed symbols, so every window of a
buffer costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_PIECE = 4 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and their inverses modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    up, down = _powers[base]
    return up[: n + 1], down[: n + 1]


def rolling(x: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of x[i:i+width] for each i; x holds 64-bit symbols."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x, salt + 1) * up[: len(x)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n], salt + 11)


@dataclass
class Words:
    """Words of several texts in order; first[i] is text i's first word, first[-1] the number of words."""

    buffer: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(texts: list[bytes]) -> Words:
    buffer = b"\n".join([*texts, b""])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.frombuffer(buffer, np.uint8)
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        to = min(len(data), at + _PIECE)
        if to < len(data):  # cut at white space; a longer word is taken whole
            gaps = np.flatnonzero(SPACE[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(SPACE[data[to:]])
                to = to + int(rest[0]) + 1 if len(rest) else len(data)
        part = data[at:to]
        gap = np.ones(len(part) + 2, bool)
        gap[1:-1] = SPACE[part]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        s, e = turn[::2], turn[1::2]
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(buffer, start, end, np.searchsorted(start, offsets), value)


def slices(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
