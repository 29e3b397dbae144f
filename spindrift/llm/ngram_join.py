"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal shingle sets are one node. The incidence matrix is dealt into column blocks by a hash of the
n-gram and packed as arrays. Each block is multiplied on its own, and the counts of all blocks are added up:

1. For each node, the columns it shares are counted. A partner of similarity t must hold t of a node's columns, so
   nodes that share fewer are discarded; most of a corpus goes here. Only the texts of the others are read on.
2. Twice, each node is multiplied with the leader of each of its columns: of the nodes of a size that allows a link, the
   one whose columns are the most common ones (the text that copies were made from). Overlaps of a pair are added up
   over the blocks. What is counted is part of the pair's overlap, so a pair whose count reaches the bound is a link; of
   a node without such a pair the best pair's whole overlap is added up. This joins groups of near copies without their
   pairs. Then nodes are discarded again, by the columns they share with nodes of other components and fitting sizes;
   the least of these sizes bounds a link's overlap from below.
3. What is left is multiplied in full: columns from rare to frequent, each node posts the prefix that this bound
   leaves. Each post is first tried with a few nodes of its column's largest component, as one link with that joins it.
   Then pairs of different components and fitting sizes that meet in a post are discarded where the bits of their sets' parities differ in
   more places than a link leaves, or where what is counted and all columns behind it stay below the bound; the exact
   overlaps of the rest are added up over the blocks of a last product. So no link between components is lost.

Step 2 only saves work for step 3; step 3 alone would find all components. In step 1 a column that many nodes of one
Arrow batch hold is folded before the shuffle: its cells are counted there and one entry is sent for them. In step 2 a
column that more than `split` nodes hold is dealt over several blocks by its nodes. Cells hold 48 bits of a n-gram's
hash besides those that choose the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._common import discard, map_arrow, shipped, staged, without_ids
from ._packing import packed, text_bytes
from .components import components

K = 5
SHARE = 75  # per cent
ROUNDS = 2
FOLDED = 16  # nodes of a batch that share a column before it is folded
BATCH_BYTES = 3 << 20
BLOCK_CELLS = 1_000_000
SPLIT = 200_000  # nodes of a column in one block
PARITY_WORDS = 8
MOST_PARTITIONS = 16_384  # a task may get several blocks, one after another
TRIED, TRIALS = 4, 3  # nodes of a large component that a post is tried with first, and how often at most
_LOW = np.uint64((1 << 48) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all rows, sorted and distinct within each row; bounds of the rows)."""
    found = W.words(data, offsets, W.BLANKS)
    grams, ok = found.grams(k)
    rows = []
    for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
        if b - a >= k:
            rows.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            rows.append(np.array([W.gram_of(found.hashes[a:b])], np.int64).view(np.uint64))
        else:
            rows.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.concatenate(rows) if rows else np.zeros(0, np.uint64), bounds


def _nodes(grams: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    raw, eight = grams.tobytes(), 8
    return np.array([xxhash.xxh3_64_intdigest(raw[a * eight : b * eight], seed) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64).view(np.int64)


def sketched(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, other (see _other), n_shingles, node (hash of the set), check (another)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                grams, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("doc_id", "other")), pa.array(np.diff(bounds)), pa.array(_nodes(grams, bounds, seed)), pa.array(_nodes(grams, bounds, seed + 1000))],
                    names=["doc_id", "other", "n_shingles", "node", "check"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", _other(), "text"), of, f"doc_id {kind}, other bigint, n_shingles bigint, node bigint, check bigint")


def _other() -> Column:
    """What tells rows without an id apart: a hash of the text; 0 for all rows with one."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")).alias("other")


# Packed column blocks. A row holds the cells of one batch in one block: nodes with their numbers of cells and their facts
# (component, score, size, partners), then the cells' grams, node after node; marks stand for folded columns; sums are
# counts that the batch has settled by itself.
BLOCK = "block int, nodes binary, cells binary, facts binary, low binary, high binary, marks binary, sums binary"
FACT = np.dtype([("group", np.int64), ("score", np.float32), ("size", np.int32)])
MARK = np.dtype([("gram", np.uint64), ("node", np.int64), ("count", np.int64)])
SUM = np.dtype([("a", np.int64), ("b", np.int64), ("n", np.int64), ("w", np.float64), ("na", np.int64), ("nb", np.int64)])
SUMS = "a bigint, b bigint, n bigint, w double, na bigint, nb bigint"
ALONE = np.int64(-(2**63))  # stands for b in sums of one node


def _added(sums: np.ndarray) -> np.ndarray:
    """SUM rows with n and w added up by a and b."""
    if not len(sums):
        return sums
    sums = sums[np.lexsort((sums["b"], sums["a"]))]
    first = np.flatnonzero(np.concatenate([[True], (sums["a"][1:] != sums["a"][:-1]) | (sums["b"][1:] != sums["b"][:-1])]))
    out = sums[first]
    out["n"], out["w"], out["na"] = np.add.reduceat(sums["n"], first), np.add.reduceat(sums["w"], first), np.maximum.reduceat(sums["na"], first)
    return out


def _single(node: np.ndarray, weight: np.ndarray, partner: np.ndarray | int = 0) -> np.ndarray:
    """SUM rows of nodes that share a column: the log of how many share it, and in na the partner's least size, negated, so that the largest na stands for the least size."""
    out = np.zeros(len(node), SUM)
    out["a"], out["b"], out["n"], out["w"], out["na"] = node, ALONE, 1, weight, -np.asarray(partner)
    return out


def _size_class(size: np.ndarray, shift: float) -> np.ndarray:
    """Sizes of one class allow a link; each round shifts the bounds of the classes."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(100 / SHARE) + shift).astype(np.int64)


def _led(gram: np.ndarray, node: np.ndarray, fact: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """SUM rows (leader, node) of cells sorted by gram, size class and rank: one for each node whose column is led by another component's node."""
    start = np.concatenate([[True], (gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])])
    leader = np.flatnonzero(start)[np.cumsum(start) - 1]
    small, large = np.minimum(fact["size"], fact["size"][leader]).astype(np.int64), np.maximum(fact["size"], fact["size"][leader]).astype(np.int64)
    led = np.flatnonzero((fact["group"] != fact["group"][leader]) & (100 * small >= SHARE * large))
    out = np.zeros(len(led), SUM)
    out["a"], out["b"], out["n"] = node[leader[led]], node[led], 1
    out["na"], out["nb"] = fact["size"][leader[led]], fact["size"][led]
    return _added(out)


def _partners(gram: np.ndarray, fact: np.ndarray) -> np.ndarray:
    """For each cell the least size, of those that allow a link with it, of its column's nodes of other components; 0 where there is none."""
    size = fact["size"].astype(np.uint64)
    _, column = np.unique(gram, return_inverse=True)
    key = (column.astype(np.uint64) << np.uint64(32)) | size
    order = np.lexsort((fact["group"], key))
    sorted_key, group = key[order], fact["group"][order]
    least = (size * np.uint64(SHARE) + np.uint64(99)) // np.uint64(100)
    at = np.searchsorted(sorted_key, (column.astype(np.uint64) << np.uint64(32)) | least)  # never beyond the cell itself
    change = np.append(np.flatnonzero((group[1:] != group[:-1]) | (sorted_key[1:] >> np.uint64(32) != sorted_key[:-1] >> np.uint64(32))) + 1, len(order))
    other = change[np.searchsorted(change, at, "right")]
    at = np.where(group[at] == fact["group"], np.minimum(other, len(order) - 1), at)
    found = sorted_key[at]
    fits = (found >> np.uint64(32) == column.astype(np.uint64)) & (group[at] != fact["group"]) & ((found & np.uint64(0xFFFFFFFF)) * np.uint64(SHARE) <= size * np.uint64(100))
    return np.where(fits, found & np.uint64(0xFFFFFFFF), np.uint64(0)).astype(np.int64)


def _folded(grams: np.ndarray, ref: np.ndarray, nodes: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which cells stay, marks, their whole grams, sums) of a batch: columns that FOLDED of its nodes hold are counted here and one mark is sent for each. A column's weight goes by the share of the batch's nodes that hold it."""
    stay = np.ones(len(grams), bool)
    own, count = _many(grams, FOLDED)
    stay[own] = False
    gram, node = grams[own], nodes[ref[own]]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(own) else own
    marks = np.zeros(len(first), MARK)
    marks["gram"], marks["node"], marks["count"] = gram[first] & _LOW, node[first], count[first]
    return stay, marks, gram[first], _added(_single(node, np.log2(count * max(1.0, total / len(nodes)))))


def _many(grams: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of the cells, by gram, of columns with at least so many cells; how many each column has)."""
    order = np.argsort(grams, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], grams[order][1:] != grams[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(order)))
    many = np.repeat(size >= least, size)
    return order[many], np.repeat(size, size)[many]


def _block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def incidence(texts: DataFrame, blocks: int, seed: int, how: str, total: int = 1, split: int = SPLIT) -> DataFrame:
    """The matrix in packed column blocks (see BLOCK); blocks from number `blocks` on hold parts of split columns.

    how: "count" (all of docs: text), "star" (text, node, component, score, n), or "pairs" (text, node, partners).
    """

    def pack(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        grams, sizes, nodes, facts = (np.concatenate([p[i] for p in parts]) for i in range(4))
        partners = [x for p in parts for x in p[4]]
        ref = np.repeat(np.arange(len(nodes)), sizes)
        _, first, place = np.unique(nodes, return_index=True, return_inverse=True)
        keep = (first[place] == np.arange(len(nodes)))[ref]  # copies in a batch are one
        grams, ref = grams[keep], ref[keep]
        marks, whole, sums = np.zeros(0, MARK), np.zeros(0, np.uint64), np.zeros(0, SUM)
        if how == "count":
            stay, marks, whole, sums = _folded(grams, ref, nodes, total)
            grams, ref = grams[stay], ref[stay]
        block = _block_of(grams, blocks)
        if how == "star" and total > split:
            own, count = _many(grams, max(2.0, split * len(nodes) / total))
            salts = np.ceil(count * (total / len(nodes)) / split).astype(np.uint64)
            salt = W.mix(nodes[ref[own]].view(np.uint64)) % salts
            block[own] = np.uint64(blocks) + W.mix(grams[own] + salt) % np.uint64(blocks)
        ids = 2 * blocks
        order = np.argsort(block.astype(np.uint16 if ids < 65536 else np.int64), kind="stable")
        grams, ref = grams[order], ref[order]
        held_by, marked = block[order], _block_of(whole, blocks)
        found = np.union1d(held_by, marked)  # only the blocks that the batch has something for
        places = zip(found.tolist(), *(np.searchsorted(x, found, side) for x in (held_by, marked) for side in ("left", "right")), strict=True)
        rows = []
        for b, first_cell, last_cell, first_mark, last_mark in places:
            own, held = slice(first_cell, last_cell), marks[first_mark:last_mark]
            used, counts = np.unique(ref[own], return_counts=True)
            if how == "star":
                more = facts[used].tobytes()
            elif how == "pairs":
                lists = [partners[r] for r in used]
                more = np.array([len(x) for x in lists], np.int64).tobytes() + b"".join(x.tobytes() for x in lists)
            else:
                more = None
            low = grams[own] & _LOW
            rows.append([b, nodes[used].tobytes(), counts.astype(np.uint32).tobytes(), more, low.astype(np.uint32).tobytes(), (low >> np.uint64(32)).astype(np.uint16).tobytes(), held.tobytes(), None])
        if rows:
            if len(sums):  # any block may carry these
                rows[int(nodes[0]) % len(rows)][-1] = sums.tobytes()
            kinds = [pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "nodes", "cells", "facts", "low", "high", "marks", "sums"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, rows = [], 0, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                if held > BATCH_BYTES or rows + j - i > 60_000:
                    yield from pack(parts)
                    parts, held, rows = [], 0, 0
                grams, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                nodes = _nodes(grams, bounds, seed) if how == "count" else batch.column("node").slice(i, j - i).to_numpy()
                facts, partners = np.zeros(j - i, FACT), []
                if how == "star":
                    for name, column in (("group", "component"), ("score", "score"), ("size", "n")):
                        facts[name] = batch.column(column).slice(i, j - i).to_numpy()
                if how == "pairs":
                    lists = batch.column("partners").slice(i, j - i)
                    partners = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in lists]
                parts.append((grams, np.diff(bounds), nodes, facts, partners))
                held, rows = held + int(offsets[j] - offsets[i]), rows + j - i
        if parts:
            yield from pack(parts)

    needed = {"count": [], "star": ["node", "component", "score", "n"], "pairs": ["node", "partners"]}[how]
    return map_arrow(texts.select("text", *needed), of, BLOCK)


def _by_block(matrix: DataFrame, blocks: int) -> DataFrame:
    return matrix.repartition(min(blocks, MOST_PARTITIONS), "block")


def _read(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) if x.is_valid else np.zeros(0, dtype) for x in table.column(name)]


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(gram, place of its node in the list of all rows' nodes, nodes of the rows, cells of the rows' nodes)."""
    nodes, cells = _read(table, "nodes", np.int64), _read(table, "cells", np.uint32)
    gram = np.concatenate(_read(table, "low", np.uint32)).astype(np.uint64)
    gram |= np.concatenate(_read(table, "high", np.uint16)).astype(np.uint64) << np.uint64(32)
    return gram, np.repeat(np.arange(sum(map(len, nodes))), np.concatenate(cells)), nodes, cells


def _out(sums: np.ndarray) -> pa.Table:
    b = pa.array(sums["b"], mask=sums["b"] == ALONE)
    return pa.table({"a": pa.array(sums["a"]), "b": b, **{c: pa.array(sums[c]) for c in ("n", "w", "na", "nb")}})


def _counted(table: pa.Table) -> pa.Table:
    """Multiplies one column block of all nodes: SUM rows of the columns that a node shares, with the sum of their log sizes."""
    gram, ref, nodes, _ = _cells(table)
    marks = np.concatenate(_read(table, "marks", MARK))
    node = np.concatenate([np.concatenate(nodes)[ref], marks["node"]])
    count = np.concatenate([np.ones(len(ref), np.int64), marks["count"]])
    gram = np.concatenate([gram, marks["gram"]])
    mark = np.arange(len(gram)) >= len(ref)
    order = np.lexsort((mark, node, gram))
    gram, node, count, mark = gram[order], node[order], count[order], mark[order]
    # copies of a node are one; nodes of a folded column are counted already
    again = np.concatenate([[False], (gram[1:] == gram[:-1]) & (node[1:] == node[:-1])])
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    size = np.diff(np.append(start, len(gram)))
    df = np.repeat(np.add.reduceat(np.where(again & ~mark, 0, count), start), size)
    single = (df > 1) & ~mark & ~again
    return _out(_added(np.concatenate([*_read(table, "sums", SUM), _single(node[single], np.log2(df[single]))])))


def _product(shift: float, blocks: int):
    """Multiplies one column block: SUM rows of nodes (columns shared with another component's node of a fitting size) and of (leader, node).

    A block of parts of split columns can't tell what its other parts hold, so all its columns count as shared with the
    least size that may be: too much here keeps nodes on, it never loses one.
    """

    def of(table: pa.Table) -> pa.Table:
        gram, ref, nodes, _ = _cells(table)
        node, fact = np.concatenate(nodes)[ref], np.concatenate(_read(table, "facts", FACT))[ref]
        kind = _size_class(fact["size"], shift)
        order = np.lexsort((node, -fact["score"], kind, gram))
        gram, node, fact, kind = gram[order], node[order], fact[order], kind[order]
        one = ~np.concatenate([[False], (gram[1:] == gram[:-1]) & (node[1:] == node[:-1])])  # copies of a node are one
        gram, node, fact, kind = gram[one], node[one], fact[one], kind[one]
        split = table.column("block")[0].as_py() >= blocks
        partner = (fact["size"].astype(np.int64) * SHARE + 99) // 100 if split else _partners(gram, fact)
        single = partner > 0
        return _out(_added(np.concatenate([_single(node[single], 0.0, partner[single]), _led(gram, node, fact, kind)])))

    return of


def multiplied(texts: DataFrame, blocks: int, seed: int, total: int, shift: float | None = None, split: int = SPLIT) -> DataFrame:
    """a, b, n, w, na, nb summed over the blocks: see _counted, and with a shift _product."""
    matrix = incidence(texts, blocks, seed, "count" if shift is None else "star", total, split)
    parts = _by_block(matrix, blocks).groupBy("block").applyInArrow(_counted if shift is None else _product(shift, blocks), SUMS)
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in "nw"], *[F.max(c).alias(c) for c in ("na", "nb")])


def _pair_product(table: pa.Table) -> pa.Table:
    """One column block: SUM rows (node, partner) with the columns they both hold."""
    gram, ref, nodes, _ = _cells(table)
    lists = []
    for own, raw in zip(nodes, table.column("facts"), strict=True):
        flat = np.frombuffer(raw.as_py(), np.int64)
        lists += np.split(flat[len(own) :], np.cumsum(flat[: len(own)])[:-1])
    nodes = np.concatenate(nodes)
    ids, place = np.unique(np.concatenate([nodes, *lists]), return_inverse=True)
    _, column = np.unique(gram, return_inverse=True)
    cells, first = np.unique((column.astype(np.uint64) << np.uint64(32)) | place[ref].astype(np.uint64), return_index=True)  # copies of a node are one
    sizes = np.array([len(x) for x in lists])
    starts = len(nodes) + np.cumsum(sizes) - sizes
    column, ref = column[first], ref[first]
    many = sizes[ref]
    asked = np.repeat(starts[ref], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    own, other = np.repeat(place[ref], many), place[asked]
    key = (np.repeat(column, many).astype(np.uint64) << np.uint64(32)) | other.astype(np.uint64)
    hit = cells[np.minimum(np.searchsorted(cells, key), len(cells) - 1)] == key if len(cells) else np.zeros(0, bool)
    out = np.zeros(int(hit.sum()), SUM)
    out["a"], out["b"], out["n"] = ids[own[hit]], ids[other[hit]], 1
    return _out(_added(out))


def overlaps(texts: DataFrame, pairs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """a, b, n: how many columns the nodes of each pair (a, b) share, 0 left out; texts has node, text.

    A pair is asked for by the node that stands in fewer pairs, so a hub's list stays short. Cells of the nodes that pairs
    name go to the blocks once, whatever number of pairs they stand in.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    both = pairs.join(ends.toDF("a", "da"), "a").join(ends.toDF("b", "db"), "b")
    by_a = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    asks = both.select(F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("partner"))
    lists = ends.select("node").join(asks.groupBy("node").agg(F.collect_list("partner").alias("partners")), "node", "left")
    rows = texts.select("node", "text").join(lists.hint("merge"), "node")
    parts = _by_block(incidence(rows, blocks, seed, "pairs"), blocks).groupBy("block").applyInArrow(_pair_product, SUMS)
    return parts.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))


def parities(texts: DataFrame) -> DataFrame:
    """node, p0, p1, …: for each of 512 hash classes of shingles, whether the node's set holds an odd number of them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                grams, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                row, bit = np.repeat(np.arange(j - i), np.diff(bounds)), grams % np.uint64(64 * PARITY_WORDS)
                out = np.zeros((j - i, PARITY_WORDS), np.uint64)
                np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, j - i), *(pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(PARITY_WORDS))],
                    names=["node", *(f"p{k}" for k in range(PARITY_WORDS))],
                )

    return map_arrow(texts.select("node", "text"), of, "node bigint, " + ", ".join(f"p{k} bigint" for k in range(PARITY_WORDS)))


def exact_links(texts: DataFrame, live: DataFrame, label: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Links (a, b) between live nodes (node, least: the least overlap of a link) of different components, all of them; texts has node, n, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                grams, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("node", "component", "n", "least")), pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(grams.view(np.int64)))],
                    names=["node", "component", "n", "least", "grams"],
                )

    sets = map_arrow(_with_component(texts, live, label).select("node", "component", "n", "least", "text"), of, "node bigint, component bigint, n bigint, least bigint, grams array<bigint>")
    cells = sets.select("node", "component", "n", "least", F.explode("grams").alias("gram"))
    columns = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = cells.join(columns.filter("low <> high").select("gram", "df"), "gram")
    # columns of one component come first in a node's order, so they only shift the places of the others
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("df"), "gram"))
    posts = shared.withColumn("from_last", rank).filter("from_last >= least")
    posts = staged(posts.groupBy("gram", "node", "component", "n", "least").agg(F.max("from_last").alias("from_last")), "join-posts")
    several = posts.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gram")
    known = staged(posts.join(several, "gram", "left_semi").join(parities(texts), "node"), "join-known")
    early = staged(_tried(texts, known, None, blocks, seed, 0), "join-tried")
    for i in range(1, TRIALS):
        found = staged(_tried(texts, known, early, blocks, seed, i), "join-tried")
        early = early.unionByName(found)
        if found.isEmpty():
            break
    # components that those links join are one from here on
    merged = components(early.select(F.col("own").alias("a"), F.col("main").alias("b"))).select(F.col("node").alias("component"), "label")
    known = staged(known.join(merged, "component", "left").withColumn("component", F.coalesce("label", "component")).drop("label"), "join-known")
    known = known.join(_main(known, 0, ["node"], 0).select("gram", "main"), "gram")
    of_side = lambda s, *more: ["gram", *(F.col(c).alias(f"{s}_{c}") for c in PARITIES), *(F.col(c).alias(f"{k}{s}") for c, k in (("component", "c"), ("n", "n"), ("from_last", "r"))), F.col("node").alias(s), *more]
    # sizes that allow a link are of one class or of neighbouring ones, so a column's posts meet by class
    kind = F.floor(F.log("n") / math.log(100 / SHARE)).cast("int")
    left = known.filter("component <> main").select(*of_side("x", F.explode(F.array(kind - 1, kind, kind + 1)).alias("kind")))
    right = known.select(*of_side("y", (F.col("component") == F.col("main")).alias("of_main"), kind.alias("kind")))
    sized = (F.col("nx") * 100 >= F.col("ny") * SHARE) & (F.col("ny") * 100 >= F.col("nx") * SHARE)
    once = (F.col("cx") != F.col("cy")) & (F.col("of_main") | (F.col("x") < F.col("y")))
    # a link's overlap is SHARE / (100 + SHARE) of both sizes together. The rarest column that both hold has all others that
    # they share behind it, on both sides; a column with fewer behind it can't be that one
    needed = (F.col("nx") + F.col("ny")) * SHARE
    sized &= (F.col("rx") * (100 + SHARE) >= needed) & (F.col("ry") * (100 + SHARE) >= needed)
    sized &= _near_parities(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))[1] <= (F.col("nx") + F.col("ny")) * (100 - SHARE)
    met = left.join(right, ["gram", "kind"]).filter(once & sized).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("sum"), F.least("rx", "ry").alias("behind"))
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.min("behind").alias("tail"), F.first("sum").alias("sum"))
    # what they share is what is counted and, at most, all that stands behind the most frequent column counted
    pairs = staged(counted.filter((F.col("m") + F.col("tail") - 1) * (100 + SHARE) >= F.col("sum") * SHARE).select("a", "b", "sum"), "join-pairs")
    found = overlaps(texts, pairs.select("a", "b"), blocks, seed).join(pairs, ["a", "b"])
    return found.filter(F.col("n") * (100 + SHARE) >= F.col("sum") * SHARE).select("a", "b").unionByName(early.select("a", "b"))


PARITIES = [f"p{i}" for i in range(PARITY_WORDS)]


def _near_parities(x, y) -> tuple[Column, Column]:
    """(bits in which the parities of x and y differ, the same as a link bounds it): they are at most the shingles that one of the sets lacks, of which a link leaves few."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(x(c).bitwiseXOR(y(c))) for c in PARITIES])
    return differ, differ * (100 + SHARE)


def _main(posts: DataFrame, few: int, columns: list[str], trial: int) -> DataFrame:
    """gram, main (the component with most posts), and `few` of its posts by a hash, as array few of the columns; only of grams that several components post."""
    some = F.array(*[F.min_by(F.struct(*columns), F.xxhash64("node", "gram", F.lit(few * trial + i))) for i in range(few)])
    by_component = posts.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("m"), some.alias("few"))
    best = F.max_by(F.struct("component", "few"), F.struct("m", "component"))
    return by_component.groupBy("gram").agg(best.alias("p"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("gram", F.col("p.component").alias("main"), F.col("p.few").alias("few"))


def _tried(texts: DataFrame, known: DataFrame, done: DataFrame | None, blocks: int, seed: int, trial: int) -> DataFrame:
    """Links a, b between components own and main, found by trying each post with a few of its column's main component; pairs of components that `done` joins already aren't tried.

    What links with one member of a large component needs no other of its pairs, so a few tries spare the join most of them:
    of all that a node meets in its columns, the one whose parities differ least is added up in full.
    """
    met = known.join(_main(known, TRIED, ["node", "n", *PARITIES], trial), "gram").filter("component <> main").withColumn("y", F.explode(F.array_distinct("few")))
    sized = (F.col("n") * 100 >= F.col("y.n") * SHARE) & (F.col("y.n") * 100 >= F.col("n") * SHARE)
    differ, bounded = _near_parities(F.col, lambda c: F.col(f"y.{c}"))
    near = met.filter(sized & (bounded <= (F.col("n") + F.col("y.n")) * (100 - SHARE)))
    best = near.groupBy("node", "main").agg(F.min(F.struct(differ.alias("differ"), F.col("y.node").alias("y"), "component", (F.col("n") + F.col("y.n")).alias("sum"))).alias("p"))
    first = F.col("node") < F.col("p.y")
    tries = best.select(*(F.when(first, x).otherwise(y).alias(c) for c, x, y in (("a", F.col("node"), F.col("p.y")), ("b", F.col("p.y"), F.col("node")))), F.col("p.component").alias("own"), "main", F.col("p.sum").alias("sum")).distinct()
    if done is not None:
        tries = tries.join(done.select("own", "main").distinct(), ["own", "main"], "left_anti")
    tries = staged(tries, "join-tries")
    found = overlaps(texts, tries.select("a", "b"), blocks, seed).join(tries, ["a", "b"])
    return found.filter(F.col("n") * (100 + SHARE) >= F.col("sum") * SHARE).select("a", "b", "own", "main")


def near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of docs.

    component_id is the least doc_id reachable by links, itself included. Null and empty texts have no
    shingles and are linked with nothing. Rows with a null id take part; their component is null only if it
    holds no id. Texts count whole, however long. Equal texts and repeated rows are one node, however many; nothing is
    capped. Other columns of docs are ignored, whatever their names. Empty tables give no rows.
    """
    spark = docs.sparkSession
    shipped(spark)
    for seed in range(8):
        light = staged(sketched(docs, seed), "join-light")
        nodes = staged(
            light.filter("n_shingles > 0").groupBy("node").agg(
                F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "other"))["other"].alias("other"), F.first("n_shingles").alias("n"),
                F.min("check").alias("low"), F.max("check").alias("high"),
            ),
            "join-nodes",
        )
        if not nodes.filter("low <> high").head(1):  # else two sets share a hash of 64 bits
            break
        discard(light, nodes)
    cells, total = nodes.agg(F.sum("n"), F.count(F.lit(1))).head()
    blocks = max(64, math.ceil((cells or 0) / BLOCK_CELLS))
    enough = F.col("shared") * 100 >= F.col("n") * SHARE
    counted = lambda df: df.filter("b IS NULL").select(F.col("a").alias("node"), F.col("n").alias("shared"), F.col("w"))
    alive = counted(multiplied(docs, blocks, seed, total)).join(nodes.select("node", "doc_id", "other", "n"), "node").filter(enough)
    alive = staged(alive.withColumn("score", F.col("w") / F.col("shared") * F.least(F.lit(1.0), F.col("shared") / F.col("n"))).select("node", "doc_id", "other", "n", "score"), "join-alive")
    texts = staged(_texts(docs, alive, seed), "join-texts", "uncompressed")
    cells, n_alive = alive.agg(F.sum("n"), F.count(F.lit(1))).head()
    if texts.count() > n_alive:  # rows that repeat with their id
        texts = staged(texts.dropDuplicates(["node"]), "join-texts", "uncompressed")
    blocks = max(16, math.ceil((cells or 0) / BLOCK_CELLS))  # a pair is summed up from a row per block
    links, label, live = None, None, None
    sure = F.col("n") * (100 + SHARE) >= (F.col("na") + F.col("nb")) * SHARE
    for i in range(ROUNDS):
        own = texts.withColumn("component", F.col("node")) if label is None else _with_component(texts, live, label)
        product = staged(multiplied(own, blocks, seed, n_alive, i / ROUNDS, split), f"join-product-{i}")
        least = F.greatest(F.ceil(F.col("n") * SHARE / 100), F.ceil((F.col("n") - F.col("na")) * SHARE / (100 + SHARE)))
        facts = product.filter("b IS NULL").select(F.col("a").alias("node"), F.col("n").alias("shared"), "na").join(alive.select("node", "n"), "node")
        live = staged(facts.withColumn("least", least).filter("shared >= least").select("node", "shared", "least"), f"join-live-{i}")
        pairs = product.filter("b IS NOT NULL")
        # the part of the overlap that is counted is enough for a link, or else the best pair's whole overlap may be
        best = pairs.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("n", "a")).alias("p"), F.max(sure).alias("linked")).filter("NOT linked").select("p.a", "b", "p.na", "p.nb")
        best = best.join(live.select(F.col("node").alias("b"), "shared"), "b").filter(F.col("shared") * (100 + SHARE) >= (F.col("na") + F.col("nb")) * SHARE)
        best = staged(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb").dropDuplicates(["a", "b"]), f"join-best-{i}")
        found = pairs.filter(sure).select("a", "b").unionByName(overlaps(texts, best.select("a", "b"), blocks, seed).join(best, ["a", "b"]).filter(sure).select("a", "b"))
        links = staged(found if links is None else links.unionByName(found), f"join-links-{i}")
        discard(product, best)
        label = components(links)
    last = staged(exact_links(texts, live, label, blocks, seed), "join-links")
    discard(texts)
    label = components(links.unionByName(last))
    member = nodes.select("node", "doc_id").join(label, "node")
    low = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = nodes.select("node", F.col("doc_id").alias("own_id")).join(member.drop("doc_id").join(low, "label").select("node", "component_id"), "node", "left")
    by_node = by_node.select(F.col("node").alias("its"), F.coalesce("component_id", "own_id").alias("component_id"))
    found = light.join(by_node, (F.col("node") == F.col("its")) & (F.col("n_shingles") > 0), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_component(texts: DataFrame, live: DataFrame, label: DataFrame) -> DataFrame:
    """The texts of live nodes with their component; sort-merge at every size, so the shuffle follows the input."""
    facts = live.join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("component"))
    return texts.join(facts.hint("merge"), "node")


def _texts(docs: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """node, n, score, text (compressed) of the given nodes: the text of the row that stands for each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keep = np.zeros(batch.num_rows, bool)
            wanted = batch.column("node").to_numpy()
            for i, j in W.chunks(offsets):
                grams, bounds = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                keep[i:j] = _nodes(grams, bounds, seed) == wanted[i:j]
            yield batch.filter(pa.array(keep))

    own = packed(docs.select("doc_id", _other(), "text"), "doc_id", "other").withColumnsRenamed({"doc_id": "its", "other": "its_other"})
    same = F.col("its").eqNullSafe(F.col("doc_id")) & (F.col("its_other") == F.col("other"))
    rows = own.join(nodes.hint("merge"), same).select("node", "n", "score", "text")
    return map_arrow(rows, of, "node bigint, n bigint, score double, text binary")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the row with its least doc_id stays; all columns, whatever their names.

    Rows without an id stay, as do rows that repeat with the id that stays. Null and empty texts stay. An empty table
    gives no rows.
    """
    drop = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return without_ids(docs, drop)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(i AS INT):CAST(i + least(len(w), 5) - 1 AS INT)], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, c.low), d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) c USING (doc_id)
"""
