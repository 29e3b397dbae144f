"""Resampling of documents towards the word statistics of a target corpus.

Features are runs of words, each in the bucket that its CRC gives. A bucket's gain is the log ratio of its smoothed
shares in target and source; a document's weight is the mean gain of its features. Weights with Gumbel noise, which a hash of
the id gives, rank the documents: taking the best is drawing without replacement in proportion to exp(weight).

A word's CRC is computed once and runs of words get theirs by the algebra of `_crc`, so no run is ever written out.
Only the bucket counts (at most `buckets` numbers) and one count per score reach the driver; documents are ranked by a
sort over ranges of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _crc
from . import _words as W
from ._common import map_arrow, ranked, staged

BUCKETS, MOST_WORDS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10


def _features(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text; for each number of words, the runs' buckets and the texts that hold them)."""
    found = W.words(data, offsets, W.NON_ALNUM)
    n_words = np.diff(found.bounds)
    row = np.repeat(np.arange(len(n_words)), n_words)
    crcs = _crc.of_words(W.LOWER[data], found.starts, found.ends)
    out = []
    for k, run in enumerate(_crc.runs(crcs, found.ends - found.starts, most)):
        own = np.flatnonzero(row[: len(run)] == row[k : k + len(run)])  # runs stay within a text
        out.append(((run[own] % np.uint32(buckets)).astype(np.int64), row[own]))
    return n_words, out


def counts(texts: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task sends its sums, the driver gets one number per bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                for found, _ in _features(data[offsets[i] : offsets[j]], offsets[i : j + 1], most, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_arrow(texts.select("text"), of, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of shares by bucket, floored; one is added to every count."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features.

    One row per row of docs, each on its own. Null and empty texts, and those without a word, have no features and weight 0; texts count
    whole, however long; ids may be null or repeat; other columns are ignored. An empty table gives no rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                n_words, found = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1], most, len(gain))
                n, sums = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for bucket, row in found:
                    bounds = np.searchsorted(row, np.arange(j - i + 1))
                    n += np.diff(bounds)
                    sums += np.diff(np.concatenate([[0], np.cumsum(gain[bucket])])[bounds])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), of, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of weighted(), staged, with score (weight and noise) and rank: 1, 2, 3... for the drawn, else null.

    Of the N rows of at least least_words words, floor(percent * N / 100) of the highest scores are drawn; ties go to the
    smaller id, null ids last, then fewer features, then less weight. Repeated rows are ranked one by one. An empty table
    gives no rows.
    """
    rows = staged(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    able = F.col("n_words") >= least_words
    # scores are integers between the least and the largest gain and noise, so there are some ten thousands of them at any size
    held = {r["score"]: r["count"] for r in rows.filter(able).groupBy("score").count().collect()}
    wanted = percent * sum(held.values()) // 100
    cutoff, above = None, 0
    for score in sorted(held, reverse=True):
        if above >= wanted:
            break
        cutoff, above = score, above + held[score]
    taken = able & (F.col("score") >= cutoff) if cutoff is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    best = ranked(rows.filter(taken), order, "rank", "importance-order")
    return rows.filter(~taken).withColumn("rank", F.lit(None).cast("long")).unionByName(best.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))))


def resample(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs as doc_id, n_words, n_features, weight, score, rank; see weighted() and drawn(). target needs a column text; an empty one makes all buckets alike there."""
    gain = gains(counts(docs, most, buckets), counts(target, most, buckets))
    return drawn(weighted(docs, gain, most), percent, least_words, seed)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), held AS (
  SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL
), vocabulary AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(w)) // 2 + 1), lambda k: ('0x' || substr(hex(w), (2 * k - 1)::INT, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM held), crc_table
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM held JOIN vocabulary USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000) / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS gain FROM buckets
), sums AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS gains FROM held JOIN vocabulary USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), weights AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce((gains - ((gains % n_features) + n_features) % n_features) // n_features, 0) AS weight FROM documents LEFT JOIN sums ON doc_id = id
), scores AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weights
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, (10 * count(*) OVER ()) // 100 AS wanted FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= wanted THEN r END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""
