"""Keyed snapshots: upsert, change counts, changes by content hash, alignment with stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.order import PLACE


def changes(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """key, change: I (new), U (any value differs), S (same), K (kept, not in incoming). Values are compared as texts."""
    shown = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(existing.columns) if c != key])), 256).alias("h"))
    a, b = shown(existing).toDF(key, "ha"), shown(incoming).toDF(key, "hb")
    change = F.when(F.col("ha").isNull(), "I").when(F.col("hb").isNull(), "K").when(F.col("ha") != F.col("hb"), "U").otherwise("S")
    return a.join(b, key, "full").select(key, change.alias("change"))


def last_by_key(rows: DataFrame, key: str, by: str = PLACE) -> DataFrame:
    """The last row of each key by the column `by`, which goes: the place that order.read() gives, or a time. Without it, or among equal ones, the row with the greatest values counts."""
    rest = [c for c in rows.columns if c not in (key, by)]
    place = F.col(by) if by in rows.columns else F.lit(0)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(place, *[F.col(c).cast("string") for c in rest])).alias("_last"))
    return last.select(key, "_last.*").select(*[c for c in rows.columns if c != by])


def upserted(existing: DataFrame, incoming: DataFrame, key: str, by: str = PLACE) -> DataFrame:
    """Existing rows, those that incoming has too replaced, and its new ones; nothing is deleted.

    Of incoming rows with one key that counts which last_by_key() takes.
    Incoming values take the stored types; what can't be one becomes null.
    """
    kinds = {f.name: f.dataType for f in existing.schema.fields}
    place = [F.col(by).alias("_place")] if by in incoming.columns else []
    own = incoming.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in existing.columns], *place)
    last = last_by_key(own, key, "_place")
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.agg(F.count_if(F.col("change") == "I").alias("n_new"), F.count_if(F.col("change") == "U").alias("n_updated"), F.count(F.lit(1)).alias("total"))


def text_hash(c):
    return F.substring(F.sha2(c, 256), 1, 16)


def hash_delta(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash) of now that stored lacks: to be encoded anew."""
    return now.join(stored.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")


def without_stale(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored vectors whose document still exists."""
    return store.join(ids.select("doc_id"), "doc_id", "left_semi")


def refreshed(store: DataFrame, encoded: DataFrame, ids: DataFrame) -> DataFrame:
    """The store after an update: newly encoded vectors replace those of their documents, those of deleted documents go."""
    return upserted(without_stale(store, ids), encoded, "doc_id")


def aligned(ids: DataFrame, store: DataFrame, dim: int) -> DataFrame:
    """Every id with its stored vector, or zeros."""
    return ids.join(store, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)))
