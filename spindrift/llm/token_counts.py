"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie whose nodes have failure links and the number of tokens that are popped on them, so a
word is read once, from left to right, and its pieces are counted without being built. All distinct words of
a chunk are walked at once: a step looks up the next symbol of every word that has one, in a sorted edge table.

The tables are made on the driver from a vocabulary file, whose size bounds what is broadcast.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _words as W
from ._common import map_arrow, shipped

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256  # the symbol after a word's last byte
_SYMBOLS = 257
_letter = (W.LOWER >= 97) & (W.LOWER <= 122) | (np.arange(256) >= 128)
_digit = (np.arange(256) >= 48) & (np.arange(256) <= 57)
#: Kinds of bytes: blanks part words; letters run together, so do other signs, digits stand alone.
KIND = np.select([W.BLANKS | (np.arange(256) == 0), _letter, _digit], [0, 1, 2], 3).astype(np.uint8)


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """Tokens as symbols (bytes, and END for a word's end) of a byte-level vocabulary file with `</w>` word ends."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code, byte_of = 256, {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            byte_of[chr(code)] = b
            code += 1
    out = []
    for name in names:
        ends = name.endswith("</w>")
        body = name.removesuffix("</w>")
        if all(c in byte_of for c in body) and (body or ends):
            out.append((*(byte_of[c] for c in body), *((END,) if ends else ())))
    return out


@dataclass
class Automaton:
    """edges: sorted node * 257 + symbol; to: where they lead; fail: failure links (-1: none); pops: tokens popped on them."""

    edges: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 where there is no edge."""
        key = nodes.astype(np.int64) * _SYMBOLS + symbols
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.to[at], -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; a word that can't be cut into tokens counts 1."""
        n = len(starts)
        node, count, at = np.zeros(n, np.int64), np.zeros(n, np.int64), starts.astype(np.int64).copy()
        bad, live = np.zeros(n, bool), np.arange(n)
        while len(live):
            done = at[live] > ends[live]
            symbol = np.where(at[live] < ends[live], data[np.minimum(at[live], len(data) - 1)].astype(np.int64), END)
            after = np.where(done, -1, self.step(node[live], symbol))
            moved = after >= 0
            node[live[moved]] = after[moved]
            at[live[moved]] += 1
            stuck = live[~moved]
            count[stuck] += self.pops[node[stuck]]
            node[stuck] = self.fail[node[stuck]]
            lost = stuck[node[stuck] < 0]
            bad[lost] = True
            live = live[~((at[live] > ends[live]) & (node[live] == 0)) & (node[live] >= 0)]
        return np.where(bad, 1, count)


def build(tokens: list[tuple[int, ...]]) -> Automaton:
    children: list[dict[int, int]] = [{}]
    final = [False]
    for token in tokens:
        u = 0
        for s in token:
            if s not in children[u]:
                children[u][s] = len(children)
                children.append({})
                final.append(False)
            u = children[u][s]
        final[u] = True
    fail, pops = [-1] * len(children), [0] * len(children)
    queue = deque([0])
    while queue:
        u = queue.popleft()
        for s, v in children[u].items():
            if final[v]:
                fail[v], pops[v] = 0, 1
            else:
                z, n = fail[u], pops[u]
                while z >= 0 and s not in children[z]:
                    z, n = fail[z], n + pops[z]
                if z >= 0:
                    fail[v], pops[v] = children[z][s], n
            queue.append(v)
    pairs = sorted((u * _SYMBOLS + s, v) for u, own in enumerate(children) for s, v in own.items())
    edges, to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return Automaton(edges, to, np.array(fail, np.int64), np.array(pops, np.int64))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts; words don't cross texts."""
    kind = KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inner = offsets[1:-1]
    new[inner[inner < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] > 0
    return starts[keep], ends[keep]


def counted(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id, n_words, n_tokens; one row per row of docs, each on its own, however long. Null and empty texts have 0 of both; other columns are ignored; an empty table gives no rows."""
    shipped(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(automaton)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                part, o = W.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                starts, ends = spans(part, o)
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * W._power("up", W._BASE, len(part))[: len(part)], out=sums[1:])
                hashes = W.mix((sums[ends] - sums[starts]) * W._power("down", W._BASE_INVERSE, len(part) + 1)[starts])
                _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                pieces = machine.lengths(part, starts[first], ends[first])[place]
                row = np.searchsorted(o, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.bincount(row, minlength=j - i)), pa.array(np.bincount(row, pieces, minlength=j - i).astype(np.int64))],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), of, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), build(read_vocabulary(vocabulary)))
