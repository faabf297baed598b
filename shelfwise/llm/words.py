"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A word is a maximal run of bytes of a class. Both classes used here hold all bytes from 0x80 on, so runs
of bytes are runs of code points. Each word has a 64-bit hash, a sum of byte values times powers of an odd
number: equal words have equal hashes, and where a contract asks for equality of words the bytes are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from shelfwise.llm.common import buffers

U64 = np.uint64
_STEP, _ODD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of sequence ``a`` followed by ``b``, element by element."""
    with np.errstate(over="ignore"):
        return mix(a * _ODD + b + _STEP)


with np.errstate(over="ignore"):
    _BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * _STEP)
    _INVERSE = U64(pow(int(_ODD), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: All but space and the bytes 9 to 13.
NOT_BLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Letters, digits and all beyond ASCII.
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of some texts: word k is ``data[start[k]:end[k]]``; text i has words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def phrase(self, first: int, stop: int) -> bytes:
        """Words first to stop, joined by spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[first:stop], self.end[first:stop]))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_ODD, _INVERSE)):
                factors = np.full(max(n, _BLOCK), base, U64)
                factors[0] = 1
                _powers[i] = np.cumprod(factors)
    return _powers[0], _powers[1]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            base = start[i]
            j = max(i + 1, int(np.searchsorted(end, base + _BLOCK, side="right")))
            part = data[base : end[j - 1]]
            power, inverse = _powers_to(len(part))
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTE_VALUES[part] * power[: len(part)], out=total[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = (total[e] - total[s]) * inverse[s]
            i = j
    return mix(out)


def read_words(texts: pa.Array, kind: np.ndarray, lower: bool = False) -> Words:
    """The words of ``binary`` texts whose bytes are of ``kind``; ``lower``: A-Z lower-cased first."""
    data, offsets = buffers(texts)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), _hashes(data, start, end))
