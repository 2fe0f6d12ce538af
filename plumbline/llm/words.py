"""Words of many texts at once, as flat numpy arrays: places, classes and 64-bit hashes.

A word is a run of ASCII letters, digits and bytes of non-ASCII characters; a point or comma between two digits belongs
to it. A-Z and the Latin-1 capitals become lower case before hashing. Words never cross texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on in blocks of about this many bytes; the arrays take some forty bytes for each.
BLOCK_BYTES = 500_000

_byte = np.arange(256)
DIGIT = (_byte >= 48) & (_byte <= 57)
WORD = DIGIT | ((_byte >= 97) & (_byte <= 122)) | ((_byte >= 65) & (_byte <= 90)) | (_byte >= 128)
CAPITAL = (_byte >= 65) & (_byte <= 90)
#: Characters after which a new sentence begins, besides the start of a text.
STOP = np.isin(_byte, np.frombuffer(b".!?:\n\r|\"", dtype=np.uint8))


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixing of integers (the published splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** i and its inverse ** i, modulo 2 ** 64."""
    inverse = pow(int(MULTIPLIER), -1, 1 << 64)
    out = []
    for base in (int(MULTIPLIER), inverse):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@dataclass
class Words:
    """Per word: its text, first byte and end within ``data``, and hash. ``opens``: first word of a sentence."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray

    def capital(self) -> np.ndarray:
        first, second = self.data[self.start], self.data[np.minimum(self.start + 1, len(self.data) - 1)]
        return CAPITAL[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))

    def number(self) -> np.ndarray:
        return DIGIT[self.data[self.start]]

    def opens(self) -> np.ndarray:
        """Whether a sentence ends between the word before and this one."""
        stops = np.append(0, np.cumsum(STOP[self.data]))
        before = np.append(0, self.end[:-1])
        return stops[self.start] > stops[before]


def split(texts: list[bytes]) -> Words:
    """The words of all ``texts``, in order."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    n = len(data)
    word = WORD[data]
    digit = DIGIT[data]
    inner = (data[1:-1] == 46) | (data[1:-1] == 44)
    word[1:-1] |= inner & digit[:-2] & digit[2:]
    change = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = change[::2], change[1::2]
    low = data + (CAPITAL[data] * 32).astype(np.uint8)
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[latin] += 32
    size = 1 << max(16, (n + 1).bit_length())
    power, inverse = powers(size)
    total = np.append(np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64))
    hashes = mix((total[end] - total[start]) * inverse[start])
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    text = np.searchsorted(ends, start, side="left") if len(texts) else np.zeros(0, np.int64)
    return Words(data, text, start, end, hashes, np.bincount(text, minlength=len(texts)))


def windows(hashes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``width`` words within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * MULTIPLIER + hashes[k:k + n]
    at = np.flatnonzero(text[:n] == text[width - 1:])
    return at, mix(total[at])
