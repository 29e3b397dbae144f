"""Files through Spark's own file systems: facts, existence, removal, and a row's place in what was read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _on(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    there, system = _on(spark, path)
    return system.exists(there)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, itself not read; none if there is no such folder."""
    there, system = _on(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(there)) if system.exists(there) else []


def delete(spark: SparkSession, path: str) -> None:
    there, system = _on(spark, path)
    system.delete(there, True)


def renamed(spark: SparkSession, path: str, to: str) -> bool:
    """One rename; false if `to` is there already or `path` isn't."""
    there, system = _on(spark, path)
    target, _ = _on(spark, to)
    return not system.exists(target) and system.rename(there, target)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share, below spark.checkpoint.dir."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spindrift-")  # a local session has one machine
        spark.sparkContext.setCheckpointDir(top)
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}"


def staged(rows: DataFrame, label: str) -> DataFrame:
    """rows, written once as Parquet in the shared folder and read again: what several plans use is computed once, and lost executors don't lose it."""
    path = shared_folder(rows.sparkSession, f"{label}-{uuid.uuid4().hex}")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, modified of the files at a path (a file, a folder or a pattern); their content isn't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
