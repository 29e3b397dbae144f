"""Product reports over typed events: timestamp, event_type, user_id, session_id, endpoint, query_text, num_sources, latency_ms, kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _days(now: Column, n: int) -> Column:
    return now - F.expr(f"INTERVAL {n} DAYS")


def headline(events: DataFrame, now: Column, query_event: str = "query_received") -> DataFrame:
    """Users, sessions and queries of the last seven days and of the seven before, in one pass; both windows hold the instant between them."""
    ts = F.col("timestamp")
    this, prev = ts >= _days(now, 7), ts.between(_days(now, 14), _days(now, 7))
    asked = F.col("event_type") == query_event
    return events.filter(ts >= _days(now, 14)).agg(
        F.count_distinct(F.when(this, F.col("user_id"))).alias("wau_this"), F.count_distinct(F.when(prev, F.col("user_id"))).alias("wau_prev"),
        F.count_distinct(F.when(this, F.col("session_id"))).alias("sessions_this"), F.count_distinct(F.when(prev, F.col("session_id"))).alias("sessions_prev"),
        F.count_if(asked & this).alias("queries_this"), F.count_if(asked & prev).alias("queries_prev"),
    )


def new_and_returning(events: DataFrame, now: Column) -> DataFrame:
    """One pass: first day and last time of each user. Events without a user count as one that may be new but never returns."""
    users = events.groupBy("user_id").agg(F.min(F.to_date("timestamp")).alias("first_day"), F.max("timestamp").alias("last"))
    week = F.to_date(now) - F.expr("INTERVAL 7 DAYS")
    return users.agg(
        F.count_if(F.col("first_day") >= week).alias("new_users"),
        F.count_if((F.col("first_day") < week) & (F.col("last") >= _days(now, 7)) & F.col("user_id").isNotNull()).alias("returning_users"),
    )


def funnel(events: DataFrame, now: Column, steps: dict[str, str]) -> DataFrame:
    """Sessions that had each event in the last seven days; steps are counted on their own."""
    return events.filter(F.col("timestamp") >= _days(now, 7)).agg(*[F.count_distinct(F.when(F.col("event_type") == e, F.col("session_id"))).alias(n) for n, e in steps.items()])


def quality(events: DataFrame, now: Column, event: str = "feedback_submitted") -> DataFrame:
    up, down = F.count_if(F.col("kind") == "rating_up"), F.count_if(F.col("kind") == "rating_down")
    return events.filter((F.col("event_type") == event) & (F.col("timestamp") >= _days(now, 7))).agg(
        up.alias("thumbs_up"), down.alias("thumbs_down"), F.count_if(F.col("kind") == "correction").alias("corrections"), F.try_divide(down, up + down).alias("down_rate")
    )


def top_texts(events: DataFrame, now: Column, keep: Column, name: str, most: int = 10) -> DataFrame:
    own = events.filter(keep & F.col("query_text").isNotNull() & (F.col("timestamp") >= _days(now, 7)))
    return own.groupBy("query_text").agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), "query_text").limit(most)


def latency(events: DataFrame, now: Column, event: str | None = "query_received") -> DataFrame:
    """p50 and p95 (values that occur) and calls by endpoint."""
    own = events.filter(F.col("latency_ms").isNotNull() & (F.col("timestamp") >= _days(now, 7)))
    if event:
        own = own.filter(F.col("event_type") == event)
    # counted by value first, so a task holds distinct latencies as rows, not all of an endpoint in one buffer
    w = Window.partitionBy("endpoint")
    values = own.groupBy("endpoint", "latency_ms").agg(F.count(F.lit(1)).alias("_n"))
    ranked = values.withColumn("_upto", F.sum("_n").over(w.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.lit(p) * F.col("_all"), F.col("latency_ms")))
    return ranked.groupBy("endpoint").agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.sum("_n").alias("calls"))


def sessions(events: DataFrame) -> DataFrame:
    """session_id, last known user, first and last time, events, kinds of events."""
    return events.groupBy("session_id").agg(
        F.max_by("user_id", F.when(F.col("user_id").isNotNull(), F.col("timestamp"))).alias("user_id"), F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("last_active_at"), F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_set("event_type")).alias("features_used"),
    )
