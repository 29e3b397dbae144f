"""Removal of long byte strings that an earlier document holds, by sampled suffixes and induced extension.

Sorting all suffixes of the corpus, with their common prefixes, by induced sorting on one machine's disk
passes the whole corpus through that machine, and its queues can't be dealt over executors. Here the sampled
suffixes of that method are kept and the rest is induced from them, as Spark shuffles:

1. In each window of 50 bytes the 24-gram with the least hash is its sample; windows in a row with one sample
   are a run. Equal windows have equal samples, wherever they stand. Runs are dealt into blocks by their
   sample, 14 bytes a run, and sorted there by (sample, content of the run, document): the first of equal runs
   owns them, the windows of the others are matched.
2. Where a sample stands in several different runs, single windows may still be equal. These runs alone are
   opened: their windows are dealt by hash and sorted in the same way.
3. Each document gets its matched runs and windows back, and drops the bytes they cover.

Windows and runs are compared by 64-bit hashes. A block's size follows from the number of blocks, which
grows with the corpus, as does the number of tasks. Of a run or window that many documents of an Arrow batch share, the
first and the last document's entries are dealt and the others are matched at once, so a common one sends two of a batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _substrings as S
from . import _words as W
from ._common import map_arrow, staged
from ._packing import packed, text_bytes

BATCH_BYTES = 6 << 20
NO_ID = np.int64(2**63 - 1)
BLOCK = "block int, docs binary, refs binary, keys binary, contents binary, settled binary"
SETTLED = np.dtype([("doc", np.int64), ("content", np.uint64)])


def _ids(batch: pa.RecordBatch, i: int, j: int) -> np.ndarray:
    """Null ids stand after all others."""
    return batch.column("doc_id").slice(i, j - i).cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _contents(data: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the bytes that a run's windows cover."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * W._power("up", W._BASE, n)[:n], out=sums[1:])
    return W.mix((sums[last + S.LENGTH] - sums[start]) * W._power("down", W._BASE_INVERSE, n)[start] + (last - start).astype(np.uint64))


def _dealt(entries: Callable, blocks: int) -> Callable:
    """A mapInArrow function that packs entries(batch, i, j, data, offsets) -> (row, key, content) into blocks by key."""

    def pack(parts: list) -> Iterator[pa.RecordBatch]:
        key, content, ref, docs = (np.concatenate([p[k] for p in parts]) for k in range(4))
        stay, settled = _folded(key, content, docs[ref])
        key, content, ref = key[stay], content[stay], ref[stay]
        block = ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        order = np.argsort(block.astype(np.uint16 if blocks < 65536 else np.int64), kind="stable")
        cuts = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
        rows = []
        for b in range(blocks):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                used, refs = np.unique(ref[own], return_inverse=True)
                rows.append([b, docs[used].tobytes(), refs.astype(np.uint16).tobytes(), key[own].astype(np.uint32).tobytes(), content[own].tobytes(), None])
        if rows:
            if len(settled):  # any block may carry these
                rows[int(settled["content"][0] % np.uint64(len(rows)))][-1] = settled.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))],
                names=["block", "docs", "refs", "keys", "contents", "settled"],
            )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, rows = [], 0, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                for a in range(i, j, 30_000):  # references are 16 bits wide
                    z = min(a + 30_000, j)
                    if rows + z - a > 60_000 or held > BATCH_BYTES:
                        yield from pack(parts)
                        parts, held, rows = [], 0, 0
                    row, key, content = entries(batch, a, z, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                    parts.append((key, content, row + rows, _ids(batch, a, z)))
                    held += int(offsets[z] - offsets[a])
                    rows += z - a
        if parts:
            yield from pack(parts)

    return of


def _folded(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entries stay, the others) of a batch: of equal entries those of its first and of its last document stay, the others are matched by the first one already."""
    order = np.lexsort((doc, content, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    own = doc[order]
    between = (own > np.repeat(own[start], size)) & (own < np.repeat(own[start + size - 1], size))
    settled = np.zeros(int(between.sum()), SETTLED)
    settled["doc"], settled["content"] = own[between], content[order][between]
    stay = np.ones(len(order), bool)
    stay[order[between]] = False
    return stay, settled


def _with_settled(table: pa.Table, doc: np.ndarray, content: np.ndarray, *masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, content and masks with the entries that batches have matched themselves, for which the first mask holds."""
    more = np.concatenate([np.frombuffer(x.as_py(), SETTLED) if x.is_valid else np.zeros(0, SETTLED) for x in table.column("settled")])
    return np.concatenate([doc, more["doc"]]), np.concatenate([content, more["content"]]), *(np.concatenate([m, np.full(len(more), i == 0)]) for i, m in enumerate(masks))


def _sorted(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(document, key, content, starts of equal keys with equal content), sorted by key, content and document."""
    docs, keys, contents = [], [], []
    for d, r, k, c in zip(*(table.column(x) for x in ("docs", "refs", "keys", "contents")), strict=True):
        docs.append(np.frombuffer(d.as_py(), np.int64)[np.frombuffer(r.as_py(), np.uint16)])
        keys.append(np.frombuffer(k.as_py(), np.uint32))
        contents.append(np.frombuffer(c.as_py(), np.uint64))
    doc, key, content = np.concatenate(docs), np.concatenate(keys), np.concatenate(contents)
    order = np.lexsort((doc, content, key))
    doc, key, content = doc[order], key[order], content[order]
    new = np.ones(len(doc), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return doc, key, content, new


def _lists(doc: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    """Documents in order, and for each pair (mask, values) the documents' lists of values."""
    some = np.zeros(len(doc), bool)
    for mask, _ in columns:
        some |= mask
    ids = np.unique(doc[some])
    out = [pa.array(ids)]
    for mask, values in columns:
        place = np.searchsorted(ids, doc[mask])
        order = np.argsort(place, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(ids)))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(bounds, pa.array(values[mask][order].view(np.int64))))
    return out


def _run_owners(table: pa.Table) -> pa.Table:
    """Per document: contents of its runs that an earlier one holds, and of runs to open."""
    doc, key, content, new = _sorted(table)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(doc)))
    matched = doc > np.repeat(doc[start], size)
    head = np.ones(len(doc), bool)
    head[1:] = key[1:] != key[:-1]
    group = np.cumsum(head) - 1
    kinds = np.bincount(group, new)
    low, high = np.full(kinds.shape, NO_ID), np.full(kinds.shape, -NO_ID)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    opened = ~matched & ((kinds > 1) & (low < high))[group]
    doc, content, matched, opened = _with_settled(table, doc, content, matched, opened)
    return pa.table(dict(zip(("doc", "runs", "opened"), _lists(doc, (matched, content), (opened, content)), strict=True)))


def _window_owners(table: pa.Table) -> pa.Table:
    doc, _, content, new = _sorted(table)
    start = np.flatnonzero(new)
    matched = doc > np.repeat(doc[start], np.diff(np.append(start, len(doc))))
    doc, content, matched = _with_settled(table, doc, content, matched)
    return pa.table(dict(zip(("doc", "windows"), _lists(doc, (matched, content)), strict=True)))


def _of_rows(values: pa.Array, rows: np.ndarray, found: np.ndarray, first: int) -> np.ndarray:
    """Which of the hashes `found`, each of row first + rows, are in that row's list."""
    out = np.zeros(len(found), bool)
    cuts = np.searchsorted(rows, np.arange(rows[-1] + 2)) if len(rows) else []
    for r in range(len(cuts) - 1):
        own = values[first + r]
        if cuts[r] < cuts[r + 1] and own.is_valid and len(own):
            out[cuts[r] : cuts[r + 1]] = np.isin(found[cuts[r] : cuts[r + 1]], own.values.to_numpy().view(np.uint64))
    return out


def _run_entries(batch, i, j, data, offsets):
    row, start, last, sample = S.runs(data, offsets)
    sample = W.mix(sample)  # least hashes crowd near zero; mixed again they are even over the blocks
    return row, sample, _contents(data, start, last) if len(start) else sample


def _window_entries(batch, i, j, data, offsets):
    row, start, last, sample = S.runs(data, offsets)
    none = np.zeros(0, np.uint64)
    if not len(row):
        return row, none, none
    use = _of_rows(batch.column("opened"), row, _contents(data, start, last), i)
    size = (last - start + 1)[use]
    at = np.repeat(start[use], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    hashes = S.gram_hashes(data, S.LENGTH)[at]
    return np.repeat(row[use], size), hashes, hashes


def matches(docs: DataFrame) -> DataFrame:
    """doc, runs, windows: for each document with matches, hashes of its matched runs and of single matched windows."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(64, math.ceil(n_bytes / 8_000_000))
    texts = docs.select("doc_id", "text")
    found = map_arrow(texts, _dealt(_run_entries, blocks), BLOCK).repartition(blocks, "block").groupBy("block").applyInArrow(_run_owners, "doc bigint, runs array<bigint>, opened array<bigint>")
    found = staged(found, "dedup-runs")
    # octets of a list are bounded by the document's own length
    opened = found.filter("size(opened) > 0").groupBy("doc").agg(F.flatten(F.collect_list("opened")).alias("opened"))
    rows = packed(docs, "doc_id").withColumn("key", F.coalesce("doc_id", F.lit(int(NO_ID)))).join(opened, F.col("key") == F.col("doc")).select("doc_id", "text", "opened")
    windows = map_arrow(rows, _dealt(_window_entries, blocks), BLOCK).repartition(blocks, "block").groupBy("block").applyInArrow(_window_owners, "doc bigint, windows array<bigint>")
    none = F.array().cast("array<bigint>")
    both = found.filter("size(runs) > 0").select("doc", "runs", none.alias("windows")).unionByName(windows.select("doc", none.alias("runs"), "windows"))
    return staged(both.groupBy("doc").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("windows")).alias("windows")), "dedup-matches")


def covered(data: np.ndarray, runs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which bytes of one text its matched runs and windows cover."""
    n = len(data)
    change = np.zeros(n + 1, np.int64)
    offsets = np.array([0, n])
    _, start, last, _ = S.runs(data, offsets)
    if len(start) and len(runs):
        hit = np.isin(_contents(data, start, last), runs)
        np.add.at(change, start[hit], 1)
        np.add.at(change, last[hit] + S.LENGTH, -1)
    if len(windows):
        at = np.flatnonzero(np.isin(S.gram_hashes(data, S.LENGTH), windows))
        np.add.at(change, at, 1)
        np.add.at(change, at + S.LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def removals(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, with broken characters replaced); one row per row of docs.

    Null and empty texts have no bytes. Rows with one doc_id don't match each other; a null id stands after
    all others, and null ids don't match each other. Texts count whole, however long: they are packed once and matched in
    pieces. Other columns of docs are ignored, whatever their names. Empty tables give no rows.
    """
    found = matches(docs)
    rows = packed(docs, "doc_id").withColumn("key", F.coalesce("doc_id", F.lit(int(NO_ID)))).join(found, F.col("key") == F.col("doc"), "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            runs, windows = batch.column("runs"), batch.column("windows")
            out = []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                gone, spans = 0, 0
                if runs[i].is_valid:
                    mask = covered(own, runs[i].values.to_numpy().view(np.uint64), windows[i].values.to_numpy().view(np.uint64))
                    gone, spans = int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                    size, own = len(own), own[~mask]
                else:
                    size = len(own)
                kept = own.tobytes()
                out.append((size, gone, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_arrow(
        rows.select("doc_id", "text", "runs", "windows"), of,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string",
    )
    return out if with_text else out.drop("kept_text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS INT), 100)) AS gram FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT gram, min(doc_id) AS first FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i FROM w JOIN f USING (gram) WHERE doc_id > first),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER p + 50 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, s, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM r) GROUP BY 1, 2),
k AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i: substr(h, CAST(CASE WHEN i = 0 THEN 1 ELSE 2 * ends[CAST(i AS INT)] + 1 END AS INT), CAST(2 * (CASE WHEN i = len(starts) THEN length(h) // 2 ELSE starts[CAST(i + 1 AS INT)] END - CASE WHEN i = 0 THEN 0 ELSE ends[CAST(i AS INT)] END) AS INT))), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
