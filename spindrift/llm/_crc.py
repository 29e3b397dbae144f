"""CRC-32 of words and of runs of words, by its algebra over GF(2).

Appending n zero bytes to a text maps its CRC by a linear map, so crc(a + b) is crc(a) shifted by the length of b,
xor crc(b). Shifts by powers of two bytes are kept as tables; a run's CRC follows from those of its words.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

POLYNOMIAL = np.uint32(0xEDB88320)
BLANK = np.uint32(zlib.crc32(b" "))
#: Words of more bytes are summed up one by one.
STEPS = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ POLYNOMIAL, c >> np.uint32(1))
    return c


BYTE = _byte_table()


def _lookup(images: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by the images of single bits, as a table for each of the four bytes of its argument."""
    out, value = np.zeros((4, 256), np.uint32), np.arange(256)
    for byte in range(4):
        for bit in range(8):
            out[byte, (value >> bit) & 1 == 1] ^= images[8 * byte + bit]
    return out


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


@functools.cache
def _shift(k: int) -> np.ndarray:
    """The table that shifts by 2**k bytes: that of one byte, squared k times."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k == 0:
        return _lookup((units >> np.uint32(8)) ^ BYTE[units & 255])
    half = _shift(k - 1)
    return _lookup(_apply(half, _apply(half, units)))


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs as they count with so many bytes behind them."""
    out, k = crcs.copy(), 0
    while len(lengths) and (int(lengths.max()) >> k):
        sel = np.flatnonzero((lengths >> k) & 1)
        out[sel] = _apply(_shift(k), out[sel])
        k += 1
    return out


def of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC of each word data[start:end]."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    start, most = starts[order], size[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-most, -STEPS, "left"))  # the words of more than STEPS bytes come first
    for k in range(int(most[long]) if long < len(order) else 0):
        n = int(np.searchsorted(-most, -k, "left"))  # words of more than k bytes
        own = c[long:n]
        c[long:n] = BYTE[(own ^ data[start[long:n] + k]) & 255] ^ (own >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~c
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def runs(crcs: np.ndarray, lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """For k from 1 to most: the CRC of the k words from each word on, joined by one blank; the last k - 1 words start none."""
    out = [crcs]
    after = shifted(np.full(len(crcs), BLANK, np.uint32), lengths) ^ crcs  # a blank and the word
    for k in range(2, most + 1):
        n = max(len(crcs) - k + 1, 0)
        out.append(shifted(out[-1][:n], lengths[k - 1 :] + 1) ^ after[k - 1 :])
    return out
