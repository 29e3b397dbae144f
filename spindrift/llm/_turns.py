"""Conversations by turn: order, and the parts in which very long ones are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ranked, staged

#: Conversations of more rows are dealt out in parts of so many.
PART_ROWS = 512


def order() -> list[Column]:
    """Rows of a conversation: by turn, nulls first, then by role and text."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def dealt(rows: DataFrame, most: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations of at most `most` rows; those of longer ones, None if there are none).

    The longer ones are ranked as a whole and get columns place (the rank) and part (place by `most`): a part of a
    conversation has at most `most` rows, and one conversation's parts go to many tasks.
    """
    sizes = rows.groupBy(F.col("conv_id").alias("long_id")).count().filter(F.col("count") > most).select("long_id")
    long = staged(sizes, f"{label}-long")
    if long.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    whole = ranked(rows.join(long, same, "left_semi"), [F.col("conv_id").asc(), *order()], "place", label)
    return rows.join(long, same, "left_anti"), whole.withColumn("part", F.floor(F.col("place") / most).cast("long"))
