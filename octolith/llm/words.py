"""Words, word hashes and word windows of many texts at once, over their UTF-8 bytes with numpy.

Both word patterns of the contracts treat every byte of a non-ASCII character as a word byte, so bytes
and characters give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from octolith.llm.common import raw

_B = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: the lower-cased byte, or 0 outside words.
ALNUM = np.where((_LOWER >= 128) | ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)), _LOWER, 0).astype(np.uint8)
#: [^\x20\x09-\x0D]+ after A-Z became a-z. Byte 0 is a word byte here; 255, which UTF-8 never has, stands for it.
SPACED = np.where((_B == 32) | ((_B >= 9) & (_B <= 13)), 0, np.where(_B == 0, 255, _LOWER)).astype(np.uint8)

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
        if n <= 1 << 23:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number moved into every other (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice of texts: byte ranges, 64-bit hashes, and the first word of each text."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        data, at = raw(texts)
        self.low = low = table[data]
        self.at = at
        inside = low != 0
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        firsts = at[:-1][at[:-1] < len(low)]
        before[firsts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        lasts = at[1:] - 1
        after[lasts[(lasts >= 0) & (lasts < len(low))]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)

    def hashes(self) -> np.ndarray:
        n = len(self.low)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.low * _power(_P, "p", n)[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * _power(_P_INV, "i", n)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, wherever they stand."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    q = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            q = q * np.uint64(0xC2B2AE3D27D4EB4F)
            out += h[j : j + count] * q
    return mix(out)
