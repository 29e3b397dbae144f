"""Trailing windows over daily roll-ups that merge: a week reads seven rows a key, whatever the number of events.

Distinct users and sessions are bitmaps by dense number, merged by "or"; latencies are KLL quantile sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, as Spark's bitmap functions have it.
SPAN = 32_768
#: KLL parameter: the rank of a quantile is off by about 1.33 % at most with 200.
KLL_K = 200


def numbered(events: DataFrame, key: str, name: str) -> DataFrame:
    """events + a dense number (from 1) of each value of key, null without one.

    A bitmap is as long as the numbers are dense, so values that aren't numbers get one here: distinct values are ranked by
    ranges, and offsets of ranges, one per partition, are added.
    """
    from ..sources.files import staged

    values = events.select(key).filter(F.col(key).isNotNull()).distinct()
    ordered = values.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    held = staged(ordered.withColumn("_part", F.shiftright("_at", 33).cast("int")), "numbered-values")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, held.groupBy("_part").count().collect())):
        offsets.append((part, before))
        before += n
    known = held.join(F.broadcast(events.sparkSession.createDataFrame(offsets, "_part int, _before long")), "_part")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return events.join(known.select(key, number.alias(name)), key, "left")


def daily_distinct(events: DataFrame, number: str, by: list[str]) -> DataFrame:
    """by, day, bucket, bits: the numbers that occur each day, as bitmaps of SPAN numbers. events has timestamp."""
    told = events.filter(F.col(number).isNotNull()).select(*by, F.to_date("timestamp").alias("day"), F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return told.groupBy(*by, "day", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def daily_latency(events: DataFrame, by: list[str], k: int = KLL_K) -> DataFrame:
    """by, day, sketch, calls of the events with a latency."""
    own = events.filter(F.col("latency_ms").isNotNull())
    return own.groupBy(*by, F.to_date("timestamp").alias("day")).agg(F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("sketch"), F.count(F.lit(1)).alias("calls"))


def _seen_from(rolled: DataFrame, days: int) -> DataFrame:
    """Every roll-up once for each of the days whose trailing window holds it, that day as `until`; only days on which anything is rolled up."""
    until = rolled.select(F.col("day").alias("until")).distinct()
    copies = rolled.withColumn("until", F.explode(F.sequence("day", F.date_add("day", days - 1), F.expr("INTERVAL 1 DAY"))))
    return copies.join(F.broadcast(until), "until", "left_semi")  # days: some thousands at most


def trailing_distinct(rolled: DataFrame, by: list[str], days: int = 7) -> DataFrame:
    """by, until, n: how many numbers occur in the `days` that end with each day; from daily_distinct(). Bitmaps of one bucket meet, so a task holds one."""
    merged = _seen_from(rolled, days).groupBy(*by, "until", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by, "until").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def trailing_latency(rolled: DataFrame, by: list[str], days: int = 7, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """by, until, p50, p95, calls of the `days` that end with each day; from daily_latency(). Quantiles within the sketch's rank error."""
    merged = _seen_from(rolled, days).groupBy(*by, "until").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("calls").alias("calls"))
    return merged.select(*by, "until", *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares], "calls")


def first_days(events: DataFrame, key: str) -> DataFrame:
    """key, first_day, last_day: a roll-up by user that merges by minimum and maximum."""
    day = F.to_date("timestamp")
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
