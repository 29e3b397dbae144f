"""Retrieval evaluation: hits, reciprocal ranks and precision, overall and by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_query(results: DataFrame, relevant: Column, keys: list[str]) -> DataFrame:
    """keys, hit, rr (of the first relevant rank), precision over what was returned."""
    first = F.min(F.when(relevant, F.col("rank")))
    return results.groupBy(*keys).agg(
        F.max(relevant.cast("int")).alias("hit"), F.coalesce(F.try_divide(F.lit(1.0), first), F.lit(0.0)).alias("rr"), F.avg(relevant.cast("double")).alias("precision")
    )


def keyword_relevance(results: DataFrame, text: Column) -> DataFrame:
    """results (with keywords array) + n_keywords found in the text, relevant: at least half of them, and one."""
    low = F.lower(text)
    found = F.size(F.filter("keywords", lambda k: low.contains(F.lower(k))))
    return results.withColumn("n_keywords", found).withColumn("relevant", F.col("n_keywords") >= F.greatest(F.lit(1), F.floor(F.size("keywords") / 2)))


def judged_by_query(results: DataFrame, keys: list[str], text: Column, metadata: Column | None = None) -> DataFrame:
    """keys, hit, rr, precision of results (doc_id, rank, keywords, expected_ids) as a search is judged.

    With expected ids a hit is one of them, else at least half of the keywords, and one, anywhere in the results; keywords
    are looked for in text and metadata. rr goes by the first expected id, else by the first result with a keyword; precision
    counts results with a keyword, else expected ids.
    """
    low = F.lower(F.concat_ws("\n", text, *([] if metadata is None else [metadata])))
    rows = results.withColumn("_found", F.filter("keywords", lambda k: low.contains(F.lower(k)))).withColumn("_own", F.array_contains("expected_ids", F.col("doc_id")))
    some, ids, words = F.size("_found") > 0, F.max(F.size("expected_ids")), F.max(F.size("keywords"))
    found = F.size(F.array_distinct(F.flatten(F.collect_list("_found"))))
    first = lambda c: F.try_divide(F.lit(1.0), F.min(F.when(c, F.col("rank"))))
    return rows.groupBy(*keys).agg(
        F.when(ids > 0, F.max("_own")).otherwise(found >= F.greatest(F.lit(1), F.floor(words / 2))).cast("int").alias("hit"),
        F.coalesce(first(F.col("_own")), first(some), F.lit(0.0)).alias("rr"),
        F.when(words > 0, F.avg(some.cast("double"))).when(ids > 0, F.avg(F.col("_own").cast("double"))).otherwise(0.0).alias("precision"),
    )


def macro(scored: DataFrame, category: str = "category") -> DataFrame:
    """Means by category and, with a null category, overall."""
    return scored.rollup(category).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("precision"), 6).alias("precision")
    )


def judged(rows: DataFrame, column: str = "verdict") -> DataFrame:
    """Scores from a judge's JSON verdict; what can't be read counts 0."""
    got = F.from_json(column, "faithfulness int, relevance int, completeness int")
    cols = {n: F.coalesce(got[n], F.lit(0)) for n in ("faithfulness", "relevance", "completeness")}
    return rows.agg(*[F.round(F.avg(c), 6).alias(n) for n, c in cols.items()], F.round(F.avg(sum(cols.values()) / 3.0), 6).alias("overall"))


def report_json(scored: DataFrame, category: str = "category") -> DataFrame:
    """report: one row of JSON with the means of all queries and, by name, those of each category; scored: category, hit, rr, precision of every query."""
    figures = F.struct("n", "hit_rate", "mrr", "precision")
    rows = macro(scored, category)
    named = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(category).isNotNull(), F.struct(F.col(category), figures.alias("figures"))))))
    return rows.agg(F.to_json(F.struct(F.max(F.when(F.col(category).isNull(), figures)).alias("overall"), named.alias("by_category"))).alias("report"))
