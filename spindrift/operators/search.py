"""Searches of many queries at once: what their texts ask for, a scored pool each, filters with fallback, spread picks.

Everything is a column of the query's row, so a batch is one plan: scores by postings, one join to the documents, windows by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..sources.files import staged
from . import documents, feedback, retrieval

WANTED = ["countries", "states", "setting", "study_type", "statuses", "sponsors", "classes"]


def wanted(queries: DataFrame, with_feedback: bool = False, k: int = 5) -> DataFrame:
    """queries (qid, text) + WANTED, widened (the text with its classes' drugs, if it asks for anything) and pool (how many documents are scored)."""
    q = F.col("text")
    found = queries.withColumns({
        "countries": X.countries(q), "states": X.states(q), "setting": X.setting_intent(q), "study_type": X.study_type(q), "statuses": X.statuses(q),
        "sponsors": X.sponsors(q), "classes": X.drug_classes_named(q),
    })
    some = lambda c: F.size(c) > 0
    attributes = F.col("study_type").isNotNull() | some("statuses") | some("sponsors") | some("classes")
    any_filter = attributes | some("countries") | some("states") | F.col("setting").isNotNull()
    sizes = [retrieval.pool_size(k, a, a or o, with_feedback) for a, o in ((True, True), (False, True), (False, False))]
    pool = F.when(attributes, sizes[0]).when(any_filter, sizes[1]).otherwise(sizes[2])
    return found.withColumn("widened", F.when(any_filter, X.with_drugs(q, F.col("classes"))).otherwise(q)).withColumn("pool", pool)


def _holds(text: Column, parts: str) -> Column:
    """Whether nothing is asked for, or one of the parts occurs in the text, upper and lower case alike."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.size(parts) == 0) | F.exists(parts, lambda p: low.contains(F.lower(p)))


def meets() -> Column:
    """Whether a document (columns of build_documents()) meets all that its query wants but classes."""
    setting = documents.setting_text()
    fits = F.coalesce(*[F.when(F.col("setting") == s, X.matches_setting(setting, s)) for s in ("neoadjuvant", "adjuvant", "metastatic")], F.lit(True))
    places = F.coalesce(X.or_null(F.col("locationInfoFull")), F.col("locationInfo"))
    return (
        _holds(F.col("locationCountries"), "countries") & _holds(places, "states") & fits & F.coalesce(F.upper("studyType") == F.col("study_type"), F.col("study_type").isNull())
        & ((F.size("statuses") == 0) | F.array_contains("statuses", F.upper("status"))) & _holds(F.col("sponsorName"), "sponsors")
    )


def _pools(asked: DataFrame, docs: DataFrame, index: retrieval.Index, most: int) -> DataFrame:
    """The pool of each query: its best documents with score, rank and what the query wants."""
    best = staged(retrieval.pruned_top_k(index.asked(asked.select("qid", "widened"), "qid", "widened"), index, most), "pools")
    # pools are few rows beside the documents, and go to them
    return docs.join(best, "doc_id").join(asked.select("qid", *WANTED, "pool"), "qid").filter(F.col("rank") <= F.col("pool"))


def filtered(pools: DataFrame) -> DataFrame:
    """What of each pool meets all filters of its query; all classes, else any, else the other filters alone; the whole pool if nothing meets those."""
    own, classes = meets(), F.col("classes")
    none = F.size(classes) == 0
    every = own & ~none & (F.size(F.array_except(classes, F.col("drug_classes"))) == 0)
    some = own & ~none & F.arrays_overlap(F.col("drug_classes"), classes)
    return retrieval.filter_ladder(pools, every, some, own, by="qid")


def placed(found: DataFrame, k: int, scores: DataFrame | None = None) -> DataFrame:
    """The k best of each query + place; with scores (doc_id, net) moved by feedback first."""
    if scores is not None:
        found = found.join(scores, "doc_id", "left").withColumn("score", feedback.moved(F.col("score"), F.col("net"))).drop("net")
    # without feedback the order of ranks is that of scores
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def retrieved(queries: DataFrame, docs: DataFrame, index: retrieval.Index, k: int = 5, scores: DataFrame | None = None) -> DataFrame:
    """For each query (qid, text) the k documents of build_documents() that a search finds, with score, rank and place."""
    asked = wanted(queries, scores is not None, k)
    most = retrieval.pool_size(k, True, True, False)
    return placed(filtered(_pools(asked, docs, index, most)), k, scores)


def chat(queries: DataFrame, docs: DataFrame, index: retrieval.Index, scores: DataFrame | None = None) -> DataFrame:
    """For each query (qid, text, disease, phase, status) the documents of a chat turn, in order of place.

    The text takes its population in front; a wide pool is cut to the phase and status asked for, if any of it has them, and spread over drug
    classes; industry-sponsored and recruiting trials come first.
    """
    told = queries.withColumn("text", X.with_population(F.col("text"), F.coalesce("disease", F.lit(""))))
    pool = retrieved(told, docs, index, K.CHAT_POOL, scores).join(queries.select("qid", F.col("phase").alias("_phase"), F.col("status").alias("_status")), "qid")
    same = lambda asked, own: F.col(asked).isNull() | (X.cleaned(F.col(own)) == F.col(asked))
    kept = retrieval.filter_ladder(pool, same("_phase", "phases") & same("_status", "status"), by="qid")
    lean = kept.select("qid", "doc_id", F.col("place").alias("rank"), F.col("drug_classes").alias("classes"))
    picked = retrieval.diversified(lean, K.CHAT_BUDGET).select("qid", "doc_id")
    tiers = [F.when(X.cleaned(F.col("sponsorClass")) == "INDUSTRY", 0).otherwise(1), F.when(X.cleaned(F.col("status")) == "RECRUITING", 0).otherwise(1)]
    order = Window.partitionBy("qid").orderBy(*tiers, F.desc("score"), "rank")
    return kept.drop("place", "_phase", "_status").join(picked, ["qid", "doc_id"]).withColumn("place", F.row_number().over(order))
