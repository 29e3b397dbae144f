"""Feedback: time-decayed scores, capped rerank, worked examples, alias dictionary, status log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from . import retrieval


def parsed_time(text: Column, otherwise: Column) -> Column:
    """ISO time, without a zone taken as UTC; what is no time becomes `otherwise`."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")), otherwise)


def decay(ts: Column, now: Column) -> Column:
    age = F.greatest((F.unix_micros(now) - F.unix_micros(ts)) / 86_400e6, F.lit(0.0))
    return F.exp(-F.log(F.lit(2.0)) * age / K.HALF_LIFE_DAYS)


def source_scores(votes: DataFrame, now: Column) -> DataFrame:
    """doc_id, net from votes (type, ts, ids): up and down votes on each shown id, halved every 30 days; ids that repeat in a vote count each time."""
    weight = F.when(F.col("type") == "rating_up", K.VOTE_UP).when(F.col("type") == "rating_down", K.VOTE_DOWN)
    shown = votes.filter(F.col("type").isin("rating_up", "rating_down")).select((weight * decay(F.col("ts"), now)).alias("w"), F.explode("ids").alias("doc_id"))
    return shown.filter("doc_id <> ''").groupBy("doc_id").agg(F.sum("w").alias("net"))


def score_parts(votes: DataFrame) -> DataFrame:
    """doc_id, top, mass: votes as sums that merge in any order, without a `now`.

    A vote of weight w at time t counts w * 2 ** (t / half-life - top), where top is the largest such exponent of the id's votes; so
    a sum is at most the number of votes, whatever the times. One pass: sums are taken to the largest exponent of all rows
    here and moved to the id's own.
    """
    weight = F.when(F.col("type") == "rating_up", K.VOTE_UP).when(F.col("type") == "rating_down", K.VOTE_DOWN)
    age = F.unix_micros("ts") / (86_400e6 * K.HALF_LIFE_DAYS)
    shown = votes.filter(F.col("type").isin("rating_up", "rating_down")).select(weight.alias("mass"), age.alias("top"), F.explode("ids").alias("doc_id"))
    return merged_parts(shown.filter("doc_id <> ''"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """doc_id, top, mass: parts of one id as one. Exponents go to the id's largest one first, so nothing overflows and only what is negligible underflows."""
    top = F.max("top").over(Window.partitionBy("doc_id"))
    scaled = parts.select("doc_id", top.alias("most"), F.col("mass"), F.col("top")).withColumn("mass", F.col("mass") * F.pow(F.lit(2.0), F.col("top") - F.col("most")))
    return scaled.groupBy("doc_id").agg(F.max("most").alias("top"), F.sum("mass").alias("mass"))


def scores_at(parts: DataFrame, now: Column) -> DataFrame:
    """doc_id, net at a time that no vote is later than: equal to source_scores() of all votes."""
    age = F.unix_micros(now) / (86_400e6 * K.HALF_LIFE_DAYS)
    return parts.select("doc_id", (F.col("mass") * F.pow(F.lit(2.0), F.col("top") - age)).alias("net"))


def moved(score: Column, net: Column) -> Column:
    """A score moved by its net feedback, by at most 0.05; without feedback it stays."""
    return score + F.tanh(F.coalesce(net, F.lit(0.0))) * K.RERANK_CAP


def reranked(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """ranked (doc_id, score, rank) with scores moved by at most 0.05, in the new order; equal scores keep theirs."""
    out = ranked.join(scores, "doc_id", "left").withColumn("score", moved(F.col("score"), F.col("net"))).drop("net")
    return out.orderBy(F.desc("score"), "rank")


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "rating_up").alias("up"), F.count_if(F.col("type") == "rating_down").alias("down"),
        F.count_if(F.col("type") == "correction").alias("corrections"), F.count_if(F.col("status") == "open").alias("open"),
    )


def examples(feedback: DataFrame) -> DataFrame:
    """Upvoted answers that may serve as examples: query, answer."""
    query, answer = X.cleaned(F.col("context.query")), X.cleaned(F.col("context.assistant_message"))
    return feedback.filter((F.col("type") == "rating_up") & (query != "") & (F.length(answer) >= K.EXAMPLE_LEAST_ANSWER)).select(
        query.alias("query"),
        F.when(F.length(answer) > K.EXAMPLE_SHOWN, F.concat(F.rtrim(F.substring(answer, 1, K.EXAMPLE_SHOWN)), F.lit("…"))).otherwise(answer).alias("answer"),
    )


def nearest_examples(examples: DataFrame, asked: DataFrame, k: int = K.EXAMPLES_PICKED, least: float = K.EXAMPLE_LEAST_SIMILARITY) -> DataFrame:
    """qid, doc_id, score: for each asked (qid, text) the k nearest examples (doc_id, text) by cosine of tf * idf over the 4,096 most frequent words, from `least` on."""
    index = retrieval.indexed(examples, "doc_id", "text", most=4096, sublinear=False)
    return retrieval.pruned_top_k(index.asked(asked, "qid", "text"), index, k).filter(F.col("score") >= least).select("qid", "doc_id", "score")


def grouped_aliases(aliases: DataFrame) -> DataFrame:
    """canonical, aliases: sorted, distinct, comma-joined."""
    return aliases.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_set("alias")), ", ").alias("aliases"))


def listed_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.orderBy("alias")


def upserted_alias(aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    alias, canonical = alias.strip().lower(), canonical.strip()
    if not alias or not canonical:
        raise ValueError("alias and canonical name must not be empty")
    return aliases.filter(F.col("alias") != alias).unionByName(aliases.sparkSession.createDataFrame([(alias, canonical)], "alias string, canonical string"))


def upserted_aliases(aliases: DataFrame, new: DataFrame, by: str = "pos") -> DataFrame:
    """aliases (alias, canonical) with new entries in place of those of the same alias; the last of an alias by `by` counts, blank ones go."""
    told = new.select(F.lower(X.cleaned(F.col("alias"))).alias("alias"), X.cleaned(F.col("canonical")).alias("canonical"), by).filter("alias <> '' AND canonical <> ''")
    last = told.groupBy("alias").agg(F.max_by("canonical", F.struct(by, "canonical")).alias("canonical"))
    return aliases.join(last.select("alias"), "alias", "left_anti").unionByName(last)


def latest_status(log: DataFrame) -> DataFrame:
    """id and the fields of its last entry: updates are appended, never written in place."""
    return log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), F.col("created_at")).alias("r")).select("id", "r.*")
