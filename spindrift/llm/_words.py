"""Words and word n-grams of Arrow text batches as 64-bit hashes, computed with NumPy over raw UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one prefix sum per chunk and mixed,
so no Python object is made for a word. Equal words have equal hashes in every batch and process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93 | 1)

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: Bytes that end a word: white space only, or everything in ASCII but letters and digits.
BLANKS = (_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D))
NON_ALNUM = (_codes <= 0x2F) | ((_codes >= 0x3A) & (_codes <= 0x60)) | ((_codes >= 0x7B) & (_codes <= 0x7F))

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + (1 << 18)), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """hashes: one per word; bounds: words [bounds[i], bounds[i+1]) belong to row i; starts, ends: byte places."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether these stay within the row)."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            factor, acc = np.uint64(1), np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                factor = np.uint64((int(factor) * int(_GRAM)) & 0xFFFFFFFFFFFFFFFF)
                acc += self.hashes[j : n - k + 1 + j] * factor
            out[: n - k + 1] = mix(acc + np.uint64(k))
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(n)
        return out, left >= k


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]."""
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, n)[starts])
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends)


def of_texts(texts: list[str], separators: np.ndarray) -> list[np.ndarray]:
    """Word hashes of a few texts, for tables that the driver makes."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    found = words(data, offsets, separators)
    return [found.hashes[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]


def gram_of(hashes: np.ndarray) -> int:
    """The hash that Words.grams gives for these words together, as a signed long."""
    found, _ = Words(hashes, np.array([0, len(hashes)]), hashes, hashes).grams(len(hashes))
    return int(found[:1].view(np.int64)[0])
