"""Benchmark decontamination by winnowing.

In every window of `span` words the k-gram with the smallest hash is selected (the first of equal ones), on both sides,
so any `span` consecutive words that document and benchmark share carry one common fingerprint at the same place.
Each selected k-gram is sent once, with the words on both sides of it that its windows hold. Fingerprints are joined by
their hash alone, and each hit is extended to the left and to the right by comparing words; an extended hit of `span`
words or more is a shared span. Items of fewer words are one window of their own length.

While benchmark fingerprints are few (counted, at most `most_broadcast`) documents drop fingerprints that no
item has while they are read; beyond that the join does it. Either way the same rows result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._common import map_arrow, staged, without_ids

SPAN, K = 10, 5
SIDE = SPAN - K  # words that a window may hold on one side of its fingerprint
PRINTS = "array<struct<print:bigint,at:int,len:int,left:array<bigint>,right:array<bigint>>>"
#: The least number of words that every span of SPAN words has on one side of a fingerprint of K.
BESIDE = (SPAN - K + 1) // 2
CONTEXT = ["print", "len", "left", "right"]


def winnow(found: W.Words, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(places of the selected k-grams in order, their hashes): the least k-gram of each window of `span` words, the first of equal ones."""
    grams, _ = found.grams(k)
    _, ok = found.grams(span)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    least, place = grams[at].copy(), at.copy()
    for j in range(1, span - k + 1):
        lower = grams[at + j] < least
        least[lower], place[lower] = grams[at + j][lower], (at + j)[lower]
    place = np.unique(place)
    return place, grams[place]


def _sides(found: W.Words, at: np.ndarray, doc: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Word hashes to the left of each fingerprint, outwards, and to the right; fewer at the ends of a text."""
    steps = np.arange(SIDE)
    out = []
    for index, inside in (
        (at[:, None] - 1 - steps, lambda i: i >= found.bounds[doc][:, None]),
        (at[:, None] + K + steps, lambda i: i < found.bounds[doc + 1][:, None]),
    ):
        mask = inside(index)
        out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32), pa.array(found.hashes[index[mask]].view(np.int64))))
    return out[0], out[1]


def _known(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return keep[np.minimum(np.searchsorted(keep, values), len(keep) - 1)] == values if len(keep) else np.zeros(len(values), bool)


def _rows(found: W.Words, keep: np.ndarray | None, short: dict[int, np.ndarray | None]) -> tuple[np.ndarray, pa.StructArray]:
    """(text of each fingerprint, in order; fingerprints): the winnowed ones with len 0, and windows of the lengths in `short`."""
    at, prints = winnow(found)
    if keep is not None:
        hit = _known(prints, keep)
        at, prints = at[hit], prints[hit]
    parts = [(prints, at, np.zeros(len(at), np.int32))]
    for length, known in short.items():
        grams, ok = found.grams(length)
        hit = np.flatnonzero(ok if known is None else ok & _known(grams, known))
        parts.append((grams[hit], hit, np.full(len(hit), length, np.int32)))
    prints, at, lens = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = np.searchsorted(found.bounds, at, "right") - 1
    order = np.argsort(doc, kind="stable")
    prints, at, lens, doc = prints[order], at[order], lens[order], doc[order]
    left, right = _sides(found, at, doc)
    none = pa.ListArray.from_arrays(np.zeros(len(at) + 1, np.int32), pa.array([], pa.int64()))
    whole = pa.array(lens > 0)
    left, right = (pc.if_else(whole, none, x) for x in (left, right))
    kinds = [pa.array(prints.view(np.int64)), pa.array((at - found.bounds[doc]).astype(np.int32)), pa.array(lens), left, right]
    return doc, pa.StructArray.from_arrays(kinds, names=["print", "at", "len", "left", "right"])


def fingerprinted(texts: DataFrame, key: str, keep: np.ndarray | None, short: dict[int, np.ndarray | None], own_length: bool = False) -> DataFrame:
    """key, text_key (of the whole text), n_words, prints; own_length: texts of fewer than SPAN words are one window."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                found = W.words(part, offsets[i : j + 1], W.NON_ALNUM)
                n_words = np.diff(found.bounds)
                doc, prints = _rows(found, keep, short)
                if own_length:
                    lengths = n_words[doc]
                    fits = np.asarray(prints.field("len").to_numpy())
                    take = np.flatnonzero(np.where(fits > 0, lengths == fits, True))
                    doc, prints = doc[take], prints.take(pa.array(take))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).astype(np.int32), prints)
                raw = part.tobytes()
                keys = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(i, j - i), pa.array(keys, pa.binary()), pa.array(n_words.astype(np.int64)), lists],
                    names=[key, "text_key", "n_words", "prints"],
                )

    kind = texts.schema[key].dataType.simpleString()
    return map_arrow(texts.select(key, "text"), of, f"`{key}` {kind}, text_key binary, n_words bigint, prints {PRINTS}")


def _extent(own: Column, its: Column) -> Column:
    """How many words are equal from the fingerprint outwards."""
    equal = F.zip_with(own, its, lambda a, b: F.coalesce(a == b, F.lit(False)))
    other = F.array_position(equal, F.lit(False))
    return F.when(other > 0, other - 1).otherwise(F.size(equal)).cast("int")


def _beside_one(side: str) -> Column:
    return F.xxhash64(F.lit(side), *[F.get(side, i) for i in range(BESIDE)])


def _beside() -> Column:
    """What a fingerprint and its partner must share besides itself: the words next to it on one side.

    A span of SPAN words around K reaches at least BESIDE words to one side, so rows meet by those to the left or by those to the
    right: a phrase that many texts share in otherwise different surroundings doesn't meet itself. Whole windows need nothing.
    """
    sides = [F.when((F.col("len") == 0) & (F.size(side) >= BESIDE), _beside_one(side)) for side in ("left", "right")]
    return F.array_compact(F.array(*sides, F.when(F.col("len") > 0, F.col("len").cast("long"))))


def extended(prints: DataFrame, contexts: DataFrame) -> DataFrame:
    """text_key, at, len, items: fingerprints of texts joined by their hash with those of items, extended; what stays below SPAN words is no hit.

    prints: text_key, print, at, len, left, right; contexts: print, len, left, right, items (one row for each surrounding of a
    fingerprint, with all items that have it, so a passage of many items is joined once).
    """
    its = contexts.select("print", F.explode(_beside()).alias("beside"), F.col("left").alias("its_left"), F.col("right").alias("its_right"), "items")
    met = prints.select("*", F.explode(_beside()).alias("beside")).join(its, ["print", "beside"])
    met = met.withColumn("l", _extent(F.col("left"), F.col("its_left"))).withColumn("r", _extent(F.col("right"), F.col("its_right")))
    whole = F.col("len") > 0
    met = met.filter(whole | (F.col("beside") == _beside_one("left")) | (F.col("l") < BESIDE))  # what both sides tell counts once
    size = F.when(whole, F.col("len")).otherwise(F.col("l") + K + F.col("r"))
    return met.select("text_key", (F.col("at") - F.when(whole, 0).otherwise(F.col("l"))).alias("at"), size.alias("size"), whole.alias("whole"), "items").filter(
        f"whole OR size >= {SPAN}"
    ).select("text_key", "at", F.col("size").alias("len"), "items")


def shared_spans(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, text_key, n_words; hits: text_key, at, len, items): every span of a document that an item shares."""
    lengths = list(range(1, SPAN))
    made = fingerprinted(benchmark, "item_id", None, dict.fromkeys(lengths), own_length=True).select(F.col("item_id").cast("string").alias("item"), F.explode("prints").alias("p"))
    contexts = staged(made.select("item", "p.*").groupBy(*CONTEXT).agg(F.collect_set("item").alias("items")), "bench-prints")
    n, used = contexts.count(), [r["len"] for r in contexts.filter("len > 0").select("len").distinct().collect()]
    keep, short = None, dict.fromkeys(used)  # else every gram of the few short lengths goes to the join
    if n <= most_broadcast:
        known = contexts.select("len", "print").distinct().toPandas()
        values = known["print"].to_numpy(np.int64).view(np.uint64)
        of_length = lambda k: np.unique(values[(known["len"] == k).to_numpy()])
        keep, short = of_length(0), {k: of_length(k) for k in used}
    found = staged(fingerprinted(docs, "doc_id", keep, short), "doc-prints")
    prints = found.filter("size(prints) > 0").select("text_key", F.explode("prints").alias("p")).select("text_key", "p.*").distinct()
    return found.drop("prints"), extended(prints, contexts)


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of docs.

    Null or empty texts have no words and no hits; a null item_id marks words but is no item in n_items;
    repeated rows of either table change nothing; an empty benchmark marks nothing, empty docs give no rows. Texts count
    whole, however long; other columns of either table are ignored, whatever their names.
    """
    found, hits = shared_spans(docs, benchmark, **settings)
    hits = staged(hits, "shared-spans")
    places = hits.groupBy("text_key", "at").agg(F.max("len").alias("len"))
    before = Window.partitionBy("text_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest(F.col("at"), F.coalesce(F.max(F.col("at") + F.col("len")).over(before), F.lit(0))))
    covered = places.withColumn("fresh", fresh).groupBy("text_key").agg(F.sum("fresh").alias("n_hit"))
    items = (
        hits.select("text_key", F.explode("items").alias("item")).distinct()
        .groupBy("text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    # a table of its own: the join below then shuffles both sides anew, and a hot text is split
    per_text = staged(covered.join(items, "text_key", "left").withColumnRenamed("text_key", "its"), "contaminated-texts")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return found.join(per_text, F.col("text_key") == F.col("its"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs that share no window with the benchmark, all columns, whatever their names.

    Rows without an id all go if one of them is hit, as do rows that repeat with an id of a hit one. Null and empty texts stay.
    """
    return without_ids(docs, contamination(docs, benchmark, **settings).filter("contaminated").select("doc_id").distinct(), null_too=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[CAST(i AS INT):CAST(i + least(len(w), 10) - 1 AS INT)], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[CAST(i AS INT):CAST(i + n - 1 AS INT)], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
