"""The order of reading: where a row stands in the files it was read from, kept with the row.

Files go by name or by the time they were written, a file's rows as they stand: by their number in a Parquet file, else by the start of
their block and their place in the task that reads it. Blocks aren't divided among tasks, so places of one block
compare. As the place goes with the row, "the first" and "the last" of a key mean the same whatever repartitions the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "pos"


def read(spark: SparkSession, path: str, form: str = "parquet", schema=None, by_time: bool = False, **options) -> DataFrame:
    """The rows of files + pos, a struct that sorts in the order of reading; what has a column of that name loses it."""
    reader = spark.read.format(form).options(**options)
    return placed((reader.schema(schema) if schema is not None else reader).load(path), form, by_time)


def placed(rows: DataFrame, form: str = "parquet", by_time: bool = False) -> DataFrame:
    """rows, just read from files of this form, + pos: no shuffle and no second pass."""
    file = [F.col("_metadata.file_path").alias("file")]
    if by_time:
        file.insert(0, F.col("_metadata.file_modification_time").alias("written"))
    if form == "parquet":
        at = [F.col("_metadata.row_index").alias("row")]
    else:
        at = [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    return rows.select(*[c for c in rows.columns if c != PLACE], F.struct(*file, *at).alias(PLACE))
