"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest, one row per distinct normalised text, with the row that stays. New
rows are ingested in two appends, long texts first. Each is folded to one row per digest (map-side, so a digest that a
third of the rows share shuffles one row per task), a sort-merge anti-join against the index tells the new digests, and
these are appended. As the longest text of a group stays, a group whose rows fall into both appends is settled by the
first one, and the anti-join keeps its shorter rows out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, staged
from ._common import fresh as fresh_name

WHITE_SPACE = " \t\n\x0b\x0c\r"
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 16, 65_536
INDEX_SCHEMA = "digest binary, keep_id long, keep_chars long, copies long"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest; no text goes further."""
    return docs.select(
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
        text_digest(F.col("text")).alias("digest"),
    )


def groups(digests: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (longest original, then smallest id, null ids last) and the group's size; partial minima fold copies before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    return digests.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "copies"
    )


class DigestIndex:
    """Catalog table with the digests seen so far.

    `buckets` fixes the number of buckets and with it the partitions of the anti-join, when the table is made. Unless it is told,
    the first ingest sets it from the rows it counts: one per ROWS_PER_BUCKET, about 128 MB of index. Appends add sorted
    files to each bucket.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        """digest, keep_id, keep_chars, copies; the table is made where there is none."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], INDEX_SCHEMA))
        return self.spark.table(self.table)

    def unseen(self, new: DataFrame) -> DataFrame:
        """Rows of `new` (one per digest) whose digest the index lacks; the index side needs no exchange."""
        return new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def expects(self, rows: int) -> None:
        """Set the number of buckets of a table that isn't there yet; of one that is, read it."""
        if self.exists():
            told = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE FORMATTED {self.table}").collect()}
            self.buckets = int(told.get("Num Buckets", self.buckets or LEAST_BUCKETS))
        elif self.buckets is None:
            self.buckets = min(max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET)), MOST_BUCKETS)

    def append(self, new: DataFrame) -> None:
        self._write(new.select("digest", "keep_id", "keep_chars", "copies").repartition(self.buckets, "digest"))

    def _write(self, rows: DataFrame) -> None:
        self.expects(0)
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def ingest(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Append the digests of `docs` that are new to `index`; returns one row per row of docs.

    doc_id, keep_id (of its group within docs), group_size, kept, text_sha256. `kept` is true for the row
    that stays of a digest the index did not have before: the rows that the anti-join let through. Rows that repeat with
    the same doc_id are all counted, and all are kept when their id is the one that stays. Null texts count as empty,
    texts count whole, however long; of equally long ones the smallest id stays, null ids last; an empty
    table gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    light = staged(digested(docs), "digests")
    middle, total = light.agg(F.percentile_approx("n_chars", 0.5), F.count(F.lit(1))).head()
    middle = middle or 0  # any number gives the same rows
    index.expects(total)
    folded, fresh = [], []
    for part in (light.filter(F.col("n_chars") >= middle), light.filter(F.col("n_chars") < middle)):
        folded.append(staged(groups(part), "digest-groups"))
        fresh.append(staged(index.unseen(folded[-1]), "digests-new"))
        index.append(fresh[-1])
    # the first append has the longer texts, so its row of a digest is the one that stays
    in_order = folded[0].withColumn("turn", F.lit(0)).unionByName(folded[1].withColumn("turn", F.lit(1)))
    whole = in_order.groupBy("digest").agg(F.min_by("keep_id", "turn").alias("keep_id"), F.sum("copies").alias("copies"))
    new = fresh[0].unionByName(fresh[1]).select(F.col("digest").alias("fresh_digest"), F.col("keep_id").alias("fresh_id"))
    settled = whole.join(new.hint("merge"), F.col("digest") == F.col("fresh_digest"), "left")
    # rows without a copy whose digest is new stay, they need no join
    many = staged(settled.filter("copies > 1 OR fresh_digest IS NULL").withColumnRenamed("digest", "its"), "digest-many")
    discard(*folded, *fresh)
    known = light.join(many, F.col("digest") == F.col("its"), "left")  # both sides are shuffled: AQE splits a hot digest
    alone = F.col("its").isNull()
    return known.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("fresh_digest").isNotNull() & F.col("doc_id").eqNullSafe(F.col("fresh_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, all columns, whatever their names; without an index of its own, copies within docs alone are dropped.

    Rows to drop are looked up by id and digest, so rows without an id are told apart by their text. Rows that
    repeat with one doc_id and text stay or go together. One of all null, empty and blank texts stays. An empty table
    gives no rows.
    """
    own = index or DigestIndex(docs.sparkSession)
    gone, digest = fresh_name(docs, "dropped_id"), fresh_name(docs, "dropped_digest")
    drop = ingest(docs, own).filter("NOT kept").select(F.col("doc_id").alias(gone), F.unhex("text_sha256").alias(digest))
    if index is None:
        own.drop()
    same = F.col("doc_id").eqNullSafe(F.col(gone)) & (text_digest(F.col("text")) == F.col(digest))
    return docs.join(drop, same, "left_anti")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    out = ingest(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)
    index.drop()
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
