"""Tables that a stream keeps: each micro-batch writes only the rows it changed, in a folder of its own number.

A batch that runs again after a failure finds its folder complete and writes nothing. What is read is the folders' rows
merged by key; every `compact_every` batches all so far become one folder, so that reading does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def last_wins(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows (with column batch) with equal keys those of the last batch; null keys are keys too."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")

    return merge


def latest(keys: list[str], by: str) -> Callable[[DataFrame], DataFrame]:
    """Of rows with equal keys the one with the largest `by`, whatever the order in which batches brought them."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*keys, "_row.*")

    return merge


@dataclass
class KeyedTable:
    """merge: from rows of several batches, with column batch, to one row per key without it."""

    spark: SparkSession
    path: str
    merge: Callable[[DataFrame], DataFrame]
    compact_every: int = 32

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders `batch=` (one micro-batch) or `upto=` (all of them so far)."""
        names = files.names(self.spark, self.path)
        found = sorted(int(x.removeprefix(f"{kind}=")) for x in names if x.startswith(f"{kind}="))
        return [n for n in found if files.exists(self.spark, f"{self.path}/{kind}={n}/_SUCCESS")]

    def _rows(self) -> DataFrame:
        """What counts: the last complete folder of all batches so far, and the batches behind it."""
        whole = self._complete("upto")[-1:]
        parts = [n for n in self._complete("batch") if not whole or n > whole[0]]
        found = [self.spark.read.parquet(f"{self.path}/{kind}={n}").withColumn("batch", F.lit(n)) for kind, ns in (("upto", whole), ("batch", parts)) for n in ns]
        if not found:
            raise FileNotFoundError(self.path)
        return reduce(DataFrame.unionByName, found)

    def read(self) -> DataFrame:
        return self.merge(self._rows())

    def write(self, rows: DataFrame, n: int) -> None:
        """foreachBatch function: the rows of batch n, one per key."""
        if not any(m >= n for m in self._complete("upto")):
            if n not in self._complete("batch"):
                rows.write.mode("overwrite").parquet(f"{self.path}/batch={n}")
            if (n + 1) % self.compact_every:
                return
            self.read().write.mode("overwrite").parquet(f"{self.path}/upto={n}")
        # only what a complete folder holds goes, also where an earlier run stopped here
        whole = self._complete("upto")[-1]
        for kind, ns in (("batch", self._complete("batch")), ("upto", self._complete("upto"))):
            for m in ns:
                if m < whole or (kind == "batch" and m == whole):
                    files.delete(self.spark, f"{self.path}/{kind}={m}")

    def run(self, stream: DataFrame, mode: str = "update", each: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """All input that there is, then stop; goes on from the checkpoint beside the table. each: what is kept of a micro-batch."""
        write = self.write if each is None else lambda rows, n: self.write(each(rows), n)
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{self.path}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
