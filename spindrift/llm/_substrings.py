"""Runs of byte windows that share a minimal k-gram, with NumPy over raw UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from . import _words as W

LENGTH, K = 50, 24


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on; they may cross texts, callers mask these."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * W._power("up", W._BASE, n)[:n], out=sums[1:])
    return W.mix((sums[k:] - sums[: n - k + 1]) * W._power("down", W._BASE_INVERSE, n)[: n - k + 1])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, least k-gram hash) of the maximal runs of `length`-byte windows with one least k-gram.

    Windows are places in data and never cross texts.
    """
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    least = gram_hashes(data, k)
    width, want = 1, length - k + 1  # least[i] covers `width` grams from i on
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)[:n]
    ok = np.arange(n) + length <= offsets[row + 1]
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return row[start], start, end, least[start]
