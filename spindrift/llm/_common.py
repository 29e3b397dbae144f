"""Shared folder, staging tables and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. A local session may go without one and gets its own; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shipped(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as --py-files would."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_spindrift_shipped", False) or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="spindrift-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._spindrift_shipped = True


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package at hand in the workers; a worker that is done gives back what Arrow holds, as it lives on for other tasks."""
    shipped(df.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(of, schema)


def map_rows(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """A function from a partition's rows, one after another, to rows of schema; Arrow batches carry both."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def batch_of(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for row in function(rows(batches)):
            some.append(row)
            size += 100 + sum(len(v) for v in row if isinstance(v, str))
            if size > 1 << 22:
                yield batch_of(some)
                some, size = [], 0
        if some:
            yield batch_of(some)

    return map_arrow(df, of, schema)


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it again: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    if (made := _made.get(None)) is not None:
        made.append(out)
    return out


#: Folders of staged tables by their frame.
_paths: dict[int, str] = {}
_made: ContextVar[list[DataFrame]] = ContextVar("tables that staged() wrote")


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that staged() writes meanwhile, once what was made of them is written elsewhere."""
    token = _made.set([])
    try:
        yield
    finally:
        discard(*_made.get())
        _made.reset(token)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that staged() wrote and nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, _paths.pop(id(df), None)
        if path is None:  # a frame made elsewhere: its first file tells the folder
            path = next(iter(df.inputFiles()), "").rpartition("/")[0]
        if path:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def ranked(rows: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """All rows with their place in the whole order, from 1 on, as column `name`; staged.

    Rows are dealt by ranges of the order and sorted there; the rows of earlier ranges are added to a row's place in its
    own. The driver gets one number per partition. Rows that are equal in `order` come in any order.
    """
    part, at = fresh(rows, "range_part"), fresh(rows, "range_at")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = staged(dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33).cast("int")), label)
    before, offsets = 0, []
    for r in sorted(held.groupBy(part).count().collect()):
        offsets.append((r[0], before))
        before += r[1]
    known = rows.sparkSession.createDataFrame(offsets, f"{part} int, range_before long")
    place = F.col("range_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(known), part).withColumn(name, place).drop(part, at, "range_before")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, null_too: bool = False) -> DataFrame:
    """The rows of docs whose doc_id is not in the one column of ids; null_too: a null there means the rows without an id."""
    name = fresh(docs, "dropped_id")
    own, its = F.col("doc_id"), F.col(name)
    return docs.join(ids.toDF(name), own.eqNullSafe(its) if null_too else own == its, "left_anti")


def ascii_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`, counted by one regular expression without an array of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as bucket 1, so it never is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1)).cast("int")
