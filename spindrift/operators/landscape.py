"""Landscape of a population: totals and ranked distributions over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X

UNSPECIFIED = "(unspecified)"


def totals(docs: DataFrame, in_population: Column, in_filter: Column) -> DataFrame:
    """population_total and total (after the filter) in one pass."""
    return docs.agg(F.count_if(in_population).alias("population_total"), F.count_if(in_population & in_filter).alias("total"))


def named_or_unspecified(c: Column) -> Column:
    return F.coalesce(X.or_null(X.cleaned(c)), F.lit(UNSPECIFIED))


def distribution(rows: DataFrame, label: Column, top: int | None = None, order: Column | None = None) -> DataFrame:
    """label, count, most frequent first; equal counts by `order` (least value in the group), else by label."""
    out = rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"), F.min(order if order is not None else label).alias("_order"))
    out = out.orderBy(F.desc("count"), "_order", "label")
    return (out.limit(top) if top else out).drop("_order")


def sections(docs: DataFrame, labels: dict[str, Column], in_filter: Column, top: dict[str, int]) -> DataFrame:
    """section, label, count: population_total and total (after the filter) and the distribution of each section's label, in one pass over docs; top: how many labels a section keeps."""
    pair = lambda s, c: F.struct(F.lit(s).alias("section"), c.alias("label"))
    heads = [F.lit("population_total"), F.when(in_filter, F.lit("total"))]
    found = docs.select(F.explode(F.array(*[pair("totals", h) for h in heads], *[pair(s, c) for s, c in labels.items()])).alias("p")).select("p.*").filter("label IS NOT NULL")
    counts = found.groupBy("section", "label").agg(F.count(F.lit(1)).alias("count"))
    zeros = docs.sparkSession.createDataFrame([("totals", "population_total", 0), ("totals", "total", 0)], "section string, label string, count long")
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), "label"))
    most = F.create_map(*[F.lit(x) for p in top.items() for x in p])
    own = counts.withColumn("_rank", rank).filter(F.coalesce(F.col("_rank") <= most[F.col("section")], F.lit(True))).drop("_rank")
    return own.unionByName(zeros).groupBy("section", "label").agg(F.sum("count").alias("count"))


def parts(c: Column, by: str = ",") -> Column:
    """Trimmed, non-empty parts of a delimited text."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), X.cleaned), lambda p: p != "")


def landscape(docs: DataFrame, disease_pattern: str | None, phase: str | None = None, status: str | None = None) -> DataFrame:
    """section, label, count, rank: totals and the six distributions of a filtered population; no rows without any filter.

    docs: build_documents(). The distributions are unions of small aggregates over one cached selection.
    """
    from .documents import population_text

    if not (disease_pattern or phase or status):
        return docs.sparkSession.createDataFrame([], "section string, label string, count long, rank int")
    population = F.lower(population_text()).rlike(disease_pattern) if disease_pattern else F.lit(True)
    keep = F.lit(True)
    if phase:
        keep &= X.cleaned(F.col("phases")) == phase
    if status:
        keep &= X.cleaned(F.col("status")) == status
    # one pass: each document yields its (section, label) pairs; order tells equal counts apart
    order = {label: i for i, (label, _) in enumerate(K.CLASS_PATTERNS)}
    ordinals = F.create_map(*[F.lit(x) for p in order.items() for x in p])
    one = lambda section, label: F.array(F.struct(F.lit(section).alias("section"), label.alias("label"), F.lit(0).alias("place")))
    many = lambda section, labels, place=None: F.transform(labels, lambda x: F.struct(F.lit(section).alias("section"), x.alias("label"), (place(x) if place else F.lit(0)).alias("place")))
    pairs = F.concat(
        one("phase", named_or_unspecified(F.col("phases"))), one("status", named_or_unspecified(F.col("status"))),
        one("sponsor_class", named_or_unspecified(F.col("sponsorClass"))), many("intervention_type", F.transform(parts(F.col("interventionType")), F.upper)),
        many("drug_class", F.col("drug_classes"), lambda x: ordinals[x]), many("geography", parts(F.col("locationCountries"), "[,;|]")),
    )
    own = docs.filter(population)
    counted = own.filter(keep).select(F.explode(pairs).alias("p")).select("p.*").groupBy("section", "label").agg(F.count(F.lit(1)).alias("count"), F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), "place", "label"))
    ranked = counted.withColumn("rank", rank).filter("CASE section WHEN 'drug_class' THEN rank <= 20 WHEN 'geography' THEN rank <= 10 ELSE true END")
    heads = own.agg(F.count(F.lit(1)).alias("population_total"), F.count_if(keep).alias("total")).select(F.expr("stack(2, 'population_total', population_total, 'total', total) AS (label, count)"))
    return heads.select(F.lit("totals").alias("section"), "label", "count", F.lit(0).alias("rank")).unionByName(ranked.select("section", "label", "count", "rank"))


def merged_filters(messages: DataFrame, name: str = "disease") -> DataFrame:
    from .conversation import carry_forward

    return carry_forward(messages, {"disease": X.disease(F.col("text")), "phase": X.phase(F.col("text")), "status": X.one_status(F.col("text"))}, name)
