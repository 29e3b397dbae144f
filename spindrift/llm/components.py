"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node it is linked with) for every node of edges (a, b).

    A round takes the least label among a node's neighbours, then the label's own label, so paths halve and
    rounds grow with the logarithm of the longest path. Rounds are cut by written tables; minima are
    combined before each shuffle, so a hub costs one row per task.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    state = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc-0")
    for i in itertools.count(1):
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = state.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("next"))
        own = own.join(jump, "label", "left").select("node", "was", F.least(F.col("label"), F.col("next")).alias("label"))
        before, state = state, staged(own, f"cc-{i}")
        discard(before)
        if not state.filter("label <> was").head(1):
            break
        state = state.drop("was")
    discard(both)
    return state.select("node", "label")
