"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances are sums over all labelled rows, made by Spark. The shares of a short text say
little, so each text's statistics are averaged with the typical ones of class 1, which weigh as much as
PULL bytes of text. Each class covariance is shrunk
towards the pooled one and towards its diagonal; its Cholesky factor is computed once, and a document's score
is the logistic of the difference of two log densities (Mahalanobis distance, log determinant, prior).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._common import crc_bucket, map_arrow, staged

_b = np.arange(256)
_CLASSES = {
    "upper": (_b >= 65) & (_b <= 90), "lower": (_b >= 97) & (_b <= 122), "digit": (_b >= 48) & (_b <= 57), "high": _b >= 128,
    "blank": W.BLANKS, "line": _b == 10, "stop": np.isin(_b, [ord(c) for c in ".,;:"]), "mark": np.isin(_b, [ord(c) for c in "!?"]),
    "symbol": W.NON_ALNUM & ~((_b >= 65) & (_b <= 90)) & ~W.BLANKS & ~np.isin(_b, [ord(c) for c in ".,;:!?'\"()-"]),
}
STATISTICS = (
    "upper", "digit", "high", "blank", "line", "stop", "mark", "symbol", "word_length", "distinct", "same_next", "same_third", "same_fifth",
)
PULL = 60


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: its weight times its STATISTICS (shares of byte classes and of repeated words, square roots taken), and what its weight lacks to 1.

    The weight of a text is its share of itself and PULL bytes; a text without bytes has weight 0.
    """
    n = len(offsets) - 1
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    out = np.zeros((n, len(STATISTICS) + 1))
    weight = size / (size + PULL)
    out[:, -1] = 1 - weight
    if not len(data):
        return out
    share = {}
    for name, has in _CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(has[data])])
        share[name] = np.diff(sums[offsets]) / np.maximum(size, 1)
    found = W.words(data, offsets, W.BLANKS)
    n_words = np.diff(found.bounds)
    row = np.repeat(np.arange(n), n_words)
    letters = share["upper"] + share["lower"] + share["high"]

    def same(k: int) -> np.ndarray:
        equal = np.zeros(len(row), bool)
        if len(row) > k:
            equal[k:] = (found.hashes[k:] == found.hashes[:-k]) & (row[k:] == row[:-k])
        return np.bincount(row, equal, minlength=n) / np.maximum(n_words, 1)

    order = np.lexsort((found.hashes, row))
    h, r = found.hashes[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[first], minlength=n) / np.maximum(n_words, 1)
    # long texts repeat more words: Herdan's measure evens that out
    herdan = np.log1p(distinct * n_words) / np.log1p(np.maximum(n_words, 1))
    columns = [
        np.sqrt(share["upper"] / np.maximum(letters, 1e-9)), *(np.sqrt(share[k]) for k in ("digit", "high", "blank", "line", "stop", "mark", "symbol")),
        np.log1p(size / np.maximum(n_words, 1)), herdan, np.sqrt(same(1)), np.sqrt(same(3)), np.sqrt(same(5)),
    ]
    for k, column in enumerate(columns):
        out[:, k] = weight * column
    return out


def described(docs: DataFrame) -> DataFrame:
    """All columns of docs but text, + statistics (see statistics()); an own column of that name is replaced. Texts are read here only, so no later step shuffles them."""
    kept = [c for c in docs.columns if c not in ("text", "statistics")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), lists], names=[*kept, "statistics"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return map_arrow(docs.select(*kept, "text"), of, f"{kinds}statistics array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS) + 1)


@dataclass
class Model:
    """typical: what short texts are averaged with; shift and scale standardise; per class: log prior, mean, inverse Cholesky factor, log determinant."""

    typical: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from rows of statistics()."""
        x = (x[:, :-1] + x[:, -1:] * self.typical - self.shift) / self.scale
        logs = []
        for prior, mean, root, determinant in self.classes:
            z = (x - mean) @ root.T
            logs.append(prior - 0.5 * determinant - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = 0.1, to_diagonal: float = 0.1) -> Model:
    """From counts, sums and sums of products of statistics() by class (0 and 1)."""
    typical = sums[1, :-1] / max(n[1] - sums[1, -1], 1e-9)
    average = np.hstack([np.eye(len(typical)), typical[:, None]])
    sums, products = sums @ average.T, average @ products @ average.T
    total = n.sum()
    shift = sums.sum(0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / total - shift**2, 1e-6))
    means = [s / max(k, 1) for s, k in zip(sums, n, strict=True)]
    within = [(p - k * np.outer(m, m)) / np.outer(scale, scale) for p, k, m in zip(products, n, means, strict=True)]
    pooled = sum(within) / total
    classes = []
    for k, m, w in zip(n, means, within, strict=True):
        cov = (1 - to_pooled) * w / max(k, 1) + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(m))
        factor = np.linalg.cholesky(cov)
        classes.append((float(np.log(max(k, 1) / total)), (m - shift) / scale, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Model(typical, shift, scale, classes)


def fit(labelled: DataFrame) -> Model | None:
    """From all rows (statistics, quality) with quality 0 or 1. None unless both classes have rows.

    Each task sends one row of sums per class, the driver gets two rows.
    """
    d = len(STATISTICS) + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(2), np.zeros((2, d + d * d))
        for batch in batches:
            label, x = batch.column("quality").to_numpy(), _matrix(batch)
            for k in (0, 1):
                own = x[label == k]
                n[k] += len(own)
                sums[k] += np.concatenate([own.sum(0), (own.T @ own).ravel()])
        for k in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(k)], pa.int32()), pa.array([float(n[k])]), pa.array([sums[k].tolist()], pa.list_(pa.float64()))], names=["quality", "n", "sums"]
            )

    rows = labelled.filter("quality IN (0, 1)").select("statistics", F.col("quality").cast("int").alias("quality"))
    parts = map_arrow(rows, of, "quality int, n double, sums array<double>")
    wide = parts.groupBy("quality").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d + d * d)])
    got = {r["quality"]: np.array(r[1:], float) for r in wide.collect()}
    if set(got) != {0, 1}:
        return None
    both = np.stack([got[0], got[1]])
    return discriminant(both[:, 0], both[:, 1 : d + 1], both[:, d + 1 :].reshape(2, d, d))


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """All columns of rows (of described()) but statistics, + quality_score (an own column of this name is replaced).

    Null and empty texts have statistics like all others: they score as typical ones. Without a model all score 0.5.
    Each row is scored alone, so rows may repeat and have any id; a text counts whole, however long; equal texts have
    equal scores; an empty table gives no rows.
    """
    kept = [c for c in rows.columns if c not in ("statistics", "quality_score")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5) if model is None else model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores)], names=[*kept, "quality_score"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return map_arrow(rows.select(*kept, "statistics"), of, f"{kinds}quality_score double")


def learn(rows: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled rows (doc_id and statistics of described()) that are not held out.

    Repeated labels of an id count once, the lowest; labels without an id or a quality don't count. The join is told to
    be a sort-merge join, so its plan is the same at every size: it shuffles fourteen numbers a row.
    """
    own = labels.filter(F.col("quality").isNotNull() & (crc_bucket(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    found = rows.select("doc_id", "statistics").join(own.hint("merge"), F.col("doc_id") == F.col("label_id"))
    return fit(found.select("statistics", "quality"))


def op4_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of documents."""
    rows = staged(described(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "quality-statistics")
    model = learn(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(rows, model).select(
        "doc_id", (crc_bucket(F.col("doc_id")) == 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )
