"""Versioned documents: append, latest, history, diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import staged
from . import retrieval


def next_versions(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new with version = the key's last version + 1 (1 for a new key); one writer is assumed."""
    last = store.groupBy(*keys).agg(F.max("version").alias("_last"))
    return new.join(last, keys, "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")


def latest(store: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest version of each key, + version_count; combined before the shuffle."""
    rest = [c for c in store.columns if c not in keys]
    out = store.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("version")).alias("r"), F.count(F.lit(1)).alias("version_count"))
    return out.select(*keys, "r.*", "version_count")


def listed(store: DataFrame, user: str, most: int = 100) -> DataFrame:
    """A user's documents, last changed first."""
    return latest(store.filter(F.col("user_id") == user), ["user_id", "protocol_id"]).orderBy(F.desc("ts"), "protocol_id").limit(most)


def initial(rows: DataFrame, now: str) -> DataFrame:
    """rows as first versions: protocol_id (drawn), version 1, ts and the change log's first entry; what rows has of these names is replaced."""
    first = {"protocol_id": F.uuid(), "version": F.lit(1), "ts": F.lit(now), "user_request": F.lit(""), "assistant_note": F.lit("Initial version")}
    return rows.drop(*first).withColumns(first)


def matched(entries: DataFrame, asked: DataFrame, fields: list[str], most: int = 10, vocabulary: int = 2048) -> DataFrame:
    """user_id, protocol_id, score, place: for each user's query (user_id, query) the `most` nearest of the user's own entries (user_id, protocol_id, ts, fields).

    Weights are fitted for each user on the entries and the query, over the user's most frequent terms; equal scores go by ts, newest first. One
    plan for all users: everything is counted and ranked by user. Texts alone are shuffled by entry, words are counted within rows.
    """
    told = F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    id_of = lambda own, protocol: F.struct("user_id", protocol.alias("protocol_id"), F.lit(own).alias("own")).alias("id")
    no_one = F.lit(None).cast(entries.schema["protocol_id"].dataType)
    texts = entries.select(id_of(0, F.col("protocol_id")), told.alias("text")).unionByName(asked.select(id_of(1, no_one), F.col("query").alias("text")))
    counts = retrieval.listed(staged(retrieval.counted(texts, "id", "text"), "user-counts")).select("doc_id.*", "term", "tf")
    sizes = texts.groupBy("id.user_id").agg(F.count(F.lit(1)).alias("n"))
    terms = counts.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("cf"), "term"))
    terms = terms.withColumn("r", rank).filter(F.col("r") <= vocabulary).join(sizes, "user_id").select("user_id", "term", (F.log((F.lit(1.0) + F.col("n")) / (F.col("df") + 1)) + 1).alias("idf"))
    terms = staged(terms, "user-terms")
    weight = (F.log("tf") + 1) * F.col("idf")
    q = counts.filter("own = 1").join(terms, ["user_id", "term"]).withColumn("w", weight)
    q = q.select("user_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("user_id")))).alias("wq"))
    told = staged(terms.join(q, ["user_id", "term"], "left"), "user-weights")
    told = F.broadcast(told) if told.count() <= retrieval.FEW_TERMS else told  # with fewer users counts stay where they are, and a document's sums are made there
    sums = counts.filter("own = 0").join(told, ["user_id", "term"]).withColumn("w", weight).groupBy("user_id", "protocol_id")
    scores = sums.agg((F.sum(F.col("w") * F.col("wq")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("score")).select("user_id", "protocol_id", F.round("score", 6).alias("score"))
    scored = lambda rows: rows.join(scores, ["user_id", "protocol_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("ts"), "protocol_id"))
    return scored(entries.join(asked.select("user_id"), "user_id", "left_semi")).withColumn("place", place).filter(F.col("place") <= most)


def with_notes(store: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """All versions with their notes, empty where there is none."""
    return store.join(log, [*keys, "version"], "left").withColumn("user_request", F.coalesce("user_request", F.lit(""))).withColumn("assistant_note", F.coalesce("assistant_note", F.lit("")))


def diff(rows: DataFrame, keys: list[str], fields: list[str], old: str = "version_a", new: str = "version_b") -> DataFrame:
    """keys, version_a, version_b, field, value_a, value_b: fields that differ between each version and the one before it."""
    w = Window.partitionBy(*keys).orderBy("version")
    shown = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lag(s).over(w).alias("value_a"), s.alias("value_b")) for f, s in zip(fields, shown, strict=True)])
    out = rows.select(*keys, F.lag("version").over(w).alias(old), F.col("version").alias(new), pairs.alias("p")).filter(f"{old} IS NOT NULL")
    return out.select(*keys, old, new, F.explode("p").alias("d")).select(*keys, old, new, "d.*").filter("value_a <> value_b")
