"""A stored table by key of which an update rewrites only what it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


@dataclass
class BucketStore:
    """Rows by key in a Parquet folder per bucket, a hash of the key; `buckets` fixes their number: take one per few hundred MB.

    An update is staged whole beside the table first and then swapped in bucket by bucket with dynamic partition overwrite. A write
    that fails before the stage is complete leaves the table as it was; one that fails later is finished by the next call of
    anything here, as the stage tells all that has to be done.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def create(self, rows: DataFrame) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.path}/table")

    def _table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/table")

    def read(self) -> DataFrame:
        self._swap()
        return self._table().drop("bucket")

    def update(self, changed: DataFrame, alive: DataFrame | None = None) -> list[int]:
        """Rows of `changed` (one per key) replace or join those of their keys; keys that `alive` (column key) lacks go. The buckets that were rewritten.

        Only keys of the whole table are read to find what went, and only touched buckets are read whole and written.
        """
        self._swap()
        table, fresh = self._table(), changed.withColumn("bucket", self._bucket())
        gone = None if alive is None else table.select(self.key, "bucket").join(alive.select(self.key), self.key, "left_anti")
        marks = fresh.select("bucket") if gone is None else fresh.select("bucket").unionByName(gone.select("bucket"))
        touched = sorted(r["bucket"] for r in marks.distinct().collect())  # at most `buckets` numbers
        if not touched:
            return []
        kept = table.filter(F.col("bucket").isin(touched)).join(changed.select(self.key), self.key, "left_anti")
        if alive is not None:
            kept, fresh = (rows.join(alive.select(self.key), self.key, "left_semi") for rows in (kept, fresh))
        made = kept.unionByName(fresh.select(*kept.columns))
        # bucket numbers that keep no row have a row of nulls in the stage, so it names all that is touched
        named = self.spark.createDataFrame([(b,) for b in touched], "bucket int").withColumn("_named", F.lit(True))
        made.unionByName(named, allowMissingColumns=True).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/stage")
        self._swap()
        return touched

    def _swap(self) -> None:
        """Put a complete stage into the table; may be repeated."""
        stage = f"{self.path}/stage"
        if not files.exists(self.spark, f"{stage}/_SUCCESS"):
            return
        rows = self.spark.read.parquet(stage)
        whole = rows.filter(F.col("_named").isNull()).drop("_named")
        full = {r["bucket"] for r in whole.select("bucket").distinct().collect()}
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/table")
        for name in files.names(self.spark, stage):
            if name.startswith("bucket=") and int(name.removeprefix("bucket=")) not in full:
                files.delete(self.spark, f"{self.path}/table/{name}")
        files.delete(self.spark, f"{stage}/_SUCCESS")
        files.delete(self.spark, stage)


def refresh(store: BucketStore, now: DataFrame, encode) -> list[int]:
    """Bring a store (key, text_hash, embedding) up to now (key, text): only texts whose hash it lacks are encoded, vectors of keys that are gone go.

    encode: from a DataFrame (key, text, text_hash) to the store's columns.
    """
    hashed = now.withColumn("text_hash", F.substring(F.sha2("text", 256), 1, 16))
    new = hashed.join(store.read().select(store.key, "text_hash"), [store.key, "text_hash"], "left_anti")
    return store.update(encode(new), hashed.select(store.key))
