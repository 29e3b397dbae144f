"""Conversation state: filters carried forward, turns that change them, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def carry_forward(turns: DataFrame, found: dict[str, Column], needed: str | None = None) -> DataFrame:
    """For each user turn, the last value of each filter so far; all are null until `needed` was seen.

    One shuffle by conversation, whose length bounds the window.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.filter("role = 'user'")
    out = own.select("conv_id", "turn", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in found.items()])
    if needed:
        out = out.select("conv_id", "turn", *[F.when(F.col(needed).isNotNull(), F.col(n)).alias(n) for n in found])
    return out


def changed_turns(state: DataFrame, names: list[str]) -> DataFrame:
    """state + changed: whether a turn's filters differ from those of the turn before (none before the first)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.lag(n).over(w))
    return state.withColumn("changed", ~same)


def transcript(turns: DataFrame, speakers: dict[str, str]) -> DataFrame:
    """conv_id, transcript: "Speaker: text" lines in order of turns."""
    who = F.create_map(*[F.lit(x) for p in speakers.items() for x in p])
    line = F.concat(F.coalesce(who[F.col("role")], F.col("role")), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))


def last_user_message(turns: DataFrame) -> DataFrame:
    """conv_id, text of the last user turn that is not blank, user_turns."""
    own = (F.col("role") == "user") & (X.cleaned(F.col("text")) != "")
    return turns.groupBy("conv_id").agg(
        F.max_by(F.when(own, F.col("text")), F.when(own, F.col("turn"))).alias("text"), F.count_if(F.col("role") == "user").alias("user_turns")
    )
