import functools
import re

import pytest

from spindrift.llm import token_counts as C

WORD = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^\x00\x20\x09-\x0Da-z0-9\x80-\xff]+")


@functools.lru_cache(maxsize=None)
def longest_of(tokens):
    return max(map(len, tokens))


@functools.lru_cache(maxsize=None)
def greedy(word, tokens):
    symbols, at, n = (*word, C.END), 0, 0
    longest = longest_of(tokens)
    while at < len(symbols):
        for size in range(min(longest, len(symbols) - at), 0, -1):
            if symbols[at : at + size] in tokens:
                break
        else:
            return 1
        at, n = at + size, n + 1
    return n


def brute(data, tokens):
    for d, t, *_ in data:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())
        yield (d, len(words), sum(greedy(w, tokens) for w in words))


@pytest.fixture(scope="module")
def vocabulary():
    return C.read_vocabulary()


def test_against_greedy_pieces(frame, rows, odd_rows, vocabulary):
    data = rows[40:80] + odd_rows + [(8000, "don't 12,5 ÄÖ\x00x naïve!!! http://a.b", None, None, 0)]
    got = sorted(map(tuple, C.counted(frame(data, clashing=True), C.build(vocabulary)).collect()), key=str)
    assert got == sorted(brute(data, frozenset(vocabulary)), key=str)


def test_words_without_pieces(frame):
    tokens = [tuple(b"a"), tuple(b"ab"), (*b"abcd", C.END), (*b"c", C.END), (*b"bcx", C.END), (C.END,)]
    data = [(i, t, None, None, 0) for i, t in enumerate(["abc", "abcd", "abcx", "a", "b", "aab", "abcd abcx z", "", None])]
    assert sorted(map(tuple, C.counted(frame(data), C.build(tokens)).collect())) == sorted(brute(data, frozenset(tokens)))
    assert C.counted(frame([]), C.build(tokens)).count() == 0
