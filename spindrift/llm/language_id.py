"""Language identification by hierarchical discrimination.

A text is a vector of hashed byte trigrams (letters only, ASCII lower-cased). A linear machine first tells
the family, then one-versus-one linear support vector machines vote between the languages of that family.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._common import crc_bucket, map_arrow

DIM = 2048
#: Families of languages by code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi bn mr ne gu pa".split(),
    "semitic": "ar he mt".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Letters stay, everything else in ASCII becomes a blank.
_LETTERS = np.where((W.LOWER >= 97) & (W.LOWER <= 122) | (np.arange(256) >= 128), W.LOWER, 32).astype(np.uint32)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of sqrt(trigram frequency), DIM wide and of length 1 (or 0 without trigrams); trigrams don't cross texts or hold two blanks."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, DIM), np.float32)
    b = _LETTERS[data]
    a, c = b[:-2], b[2:]
    code = (a * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
    row = np.repeat(np.arange(n), np.diff(offsets))
    ok = (row[:-2] == row[2:]) & (b[1:-1] != 32) & ((a != 32) | (c != 32))
    counts = np.bincount(row[:-2][ok] * DIM + code[ok], minlength=n * DIM).reshape(n, DIM).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted evenly; y is +1 or -1. Accelerated gradient descent."""
    n, d = x.shape
    x = np.hstack([x, np.ones((n, 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(d + 1, np.float32)
    z, t, rate = w.copy(), 1.0, 1.0 / (2 * 2.0 + ridge)  # rows have length sqrt(2) at most
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z)) * share
        gradient = ridge * z - 2 * (x.T @ (y * slack))
        after = z - rate * gradient
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = after + (t - 1) / t_after * (after - w)
        w, t = after, t_after
    return w


@dataclass
class Model:
    """families: names; family_weights: one column each; pairs: by family, (i, j, weights) over its languages."""

    families: list[str]
    languages: list[list[str]]
    family_weights: np.ndarray
    pairs: list[list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages, scores in 0 to 1) of the rows of x."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        p_family = _softmax(x @ self.family_weights)
        best = p_family.argmax(1)
        names, scores = np.empty(len(x), object), np.zeros(len(x))
        for f, own in enumerate(self.languages):
            rows = np.flatnonzero(best == f)
            votes, margins = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, j, w in self.pairs[f]:
                m = x[rows] @ w
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margins[:, i] += np.clip(m, -3, 3)
                margins[:, j] -= np.clip(m, -3, 3)
            if len(rows):
                p = _softmax(margins / max(1, len(own) - 1))
                top = (votes + p / 2).argmax(1)  # margins part equal votes
                names[rows] = np.array(own, object)[top]
                scores[rows] = p_family[rows, f] * p[np.arange(len(rows)), top]
        return names, scores


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(3 * (margins - margins.max(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def described(rows: DataFrame) -> DataFrame:
    """doc_id, lang and the text's vector, as half floats: a few KB a row, however long the text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            for i, j in W.chunks(offsets):
                x = vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "lang")), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "lang", "vector"])

    return map_arrow(rows.select("doc_id", "lang", "text"), of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, vector binary")


def fit(labelled: DataFrame, per_language: int = 500) -> Model | None:
    """Fit on a sample of the rows with text and lang: about `per_language` rows of each language, chosen by a hash of the id and text.

    That bound, times the number of languages, is how many vectors the driver gets. None if no language is given.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(3), F.coalesce(F.xxhash64("doc_id"), F.xxhash64("text"))), F.lit(1 << 30)) / float(1 << 30)
    sample = described(rows.filter(draw < share)).toPandas()
    if sample.empty:  # few rows, none of them drawn
        sample = described(rows.orderBy("doc_id", "text").limit(per_language)).toPandas()
    return train(sample.sort_values(["doc_id", "vector"]))


def train(sample: pd.DataFrame) -> Model:
    x = np.frombuffer(b"".join(sample["vector"]), np.float16).reshape(len(sample), DIM).astype(np.float32)
    lang = sample["lang"].to_numpy(object)
    names = sorted(set(lang))
    family_of = {n: _FAMILY_OF.get(n, n) for n in names}
    families = sorted(set(family_of.values()))
    languages = [[n for n in names if family_of[n] == f] for f in families]
    family = np.array([family_of[n] for n in lang], object)
    weights = np.stack([svm(x, np.where(family == f, 1, -1).astype(np.float32)) if len(families) > 1 else np.zeros(DIM + 1, np.float32) for f in families], 1)
    pairs = []
    for own in languages:
        found = []
        for i, j in itertools.combinations(range(len(own)), 2):
            rows = (lang == own[i]) | (lang == own[j])
            found.append((i, j, svm(x[rows], np.where(lang[rows] == own[i], 1, -1).astype(np.float32))))
        pairs.append(found)
    return Model(families, languages, weights, pairs)


def identify(docs: DataFrame, model: Model | None, name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All columns of docs, + the language as `name` and its `score` (own columns of these names are replaced).

    `und` with score 0 for null texts and texts without a letter, and for all if there is no model. Each row is handled
    alone: rows may repeat and have any id or none, equal texts have equal results, texts count whole, however long, and an
    empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in (name, score)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column("text"))
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for i, j in W.chunks(offsets):
                part, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                letters = np.concatenate([[0], np.cumsum(_LETTERS[part] != 32)])
                ascii_letters = np.concatenate([[0], np.cumsum((_LETTERS[part] >= 97) & (_LETTERS[part] <= 122))])
                some, plain = np.diff(letters[o]) > 0, np.diff(ascii_letters[o]) > 0
                for row in np.flatnonzero(some & ~plain):
                    some[row] = any(ch.isalpha() for ch in part[o[row] : o[row + 1]].tobytes().decode("utf-8", "replace"))
                if model is not None and some.any():
                    found, sure = model.predict(vectors(part, o))
                    names[i:j] = np.where(some, found, "und")
                    scores[i:j] = np.where(some, sure, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores)], names=[*kept, name, score]
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_arrow(docs.select(*kept), of, f"{kinds}, `{name}` string, `{score}` double")


def learn(docs: DataFrame) -> Model | None:
    """The model of the rows that are not held out (crc32 of the id modulo 5 is not 0)."""
    return fit(docs.filter(crc_bucket(F.col("doc_id")) != 0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), learn(docs)).select(
        "doc_id", (crc_bucket(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
