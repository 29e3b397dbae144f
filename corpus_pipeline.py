"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontamination, exact_dedup, language_id, ngram_join, source_mix
from spindrift.llm._common import discard, fresh, scratch, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without text or letters (`und`) go.

    The model is learnt from docs themselves. Null and empty texts go; rows without an id or language are kept if their
    text has a letter; rows that repeat stay, however many. Texts count whole. Columns stay as they are, one named
    lang_pred or lang_score too. An empty table gives no rows.
    """
    known, score = fresh(docs, "found"), fresh(docs, "sure")
    found = language_id.identify(docs, language_id.learn(docs), known, score)
    return found.filter(found[known] != "und").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the one with the smallest id.

    Null and empty texts are one group. Ids that are null come last, and rows are told apart by their text then; rows that
    repeat with id and text stay or go together. Texts count whole. All columns stay; an empty table gives no rows.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and empty texts and rows without an id stay, as do rows that repeat with the id that stays. Texts count whole. All
    columns stay; an empty table gives no rows.
    """
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark.

    Null and empty texts stay; rows without an id all go if one of them is hit, as do rows that repeat with an id of a hit
    one. Texts count whole. All columns stay; an empty table gives no rows, an empty benchmark drops none.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is drawn, with its output shard and place.

    Documents without words (null and empty texts) are never drawn; rows that repeat with one id, and rows without one, are
    drawn as one; a null source is a source of its own. All columns stay, but ones named as the four new ones are replaced.
    An empty table gives no rows.
    """
    return source_mix.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
]

#: No SQL for a learned model and components of near copies; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch():  # what the stage has written on its way goes as soon as its result is written
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        if before is not None:
            discard(before)
        docs = before = spark.read.schema(out.schema).parquet(path)
    return docs
