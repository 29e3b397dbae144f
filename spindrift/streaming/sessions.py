"""Session roll-up as a stream: the batch report's result, kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from .keyed import KeyedTable, last_wins


def read_events(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """Parquet events as a stream; event time without a zone is made a point in time, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def with_state_store(spark: SparkSession) -> None:
    """State on executors' disks, not in their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def updated_parts(events: DataFrame, key: str, keep_hours: int = 24) -> DataFrame:
    """The parts of sessions that a micro-batch changes: key, part (where a stretch of `keep_hours` begins), last_user (at, user_id: the last one known), started_at,
    last_active_at, event_count, features_used.

    events: a stream with a watermark on ts, and user_id, event_type and the key. State is one row per key and part, kept by Spark's own
    aggregation; it goes when the watermark has passed the part, and later rows of that part are dropped.
    """
    with_state_store(events.sparkSession)
    user = F.col("user_id").cast("string")
    made = events.groupBy(F.col(key), F.window("ts", f"{keep_hours} hours").alias("_window")).agg(
        F.max(F.when(user.isNotNull(), F.struct(F.col("ts").alias("at"), user.alias("user_id")))).alias("last_user"), F.min("ts").alias("started_at"),
        F.max("ts").alias("last_active_at"), F.count(F.lit(1)).alias("event_count"), F.collect_set("event_type").alias("features_used"),
    )
    return made.withColumn("part", F.col("_window.start")).drop("_window")


def joined_parts(parts: DataFrame, key: str, quiet_hours: int) -> DataFrame:
    """The last session of each key: its parts since it was last quiet for longer than `quiet_hours`. key, user_id (not if it is the key), started_at, last_active_at, event_count, features_used."""
    own = Window.partitionBy(key)
    before = F.lag("last_active_at").over(own.orderBy("part"))
    begins = before.isNull() | (F.unix_micros("started_at") - F.unix_micros(before) > quiet_hours * 3_600_000_000)
    told = parts.withColumn("_begins", F.when(begins, F.col("part"))).withColumn("_since", F.max("_begins").over(own)).filter(F.col("part") >= F.col("_since"))
    user = [] if key == "user_id" else [F.max("last_user")["user_id"].alias("user_id")]
    return told.groupBy(key).agg(
        *user, F.min("started_at").alias("started_at"), F.max("last_active_at").alias("last_active_at"), F.sum("event_count").alias("event_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("features_used")))).alias("features_used"),
    )


def kept_sessions(events: DataFrame, key: str, path: str, keep_hours: int = 24, late_hours: int = 0) -> DataFrame:
    """Sessions of all events that there are, as a table below path that goes on with the next call; a micro-batch writes only the parts it changed.

    A key that is quiet for longer than keep_hours and late_hours (how late rows may come) begins a new session.
    """
    table = KeyedTable(events.sparkSession, f"{path}/sessions", last_wins([key, "part"]))
    table.run(updated_parts(events, key, keep_hours))
    return joined_parts(table.read(), key, keep_hours + late_hours)


def without_repeats(stream: DataFrame, keys: list[str], delay: str, at: str = "ts") -> DataFrame:
    """Rows that overlapping micro-batches bring again go: of rows with equal keys whose times are less than `delay` apart the first stays. Spark keeps a key that long only, so rows without a time, which never grow old, go."""
    return stream.filter(F.col(at).isNotNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def overlapping(rows: DataFrame, since: Column, overlap: str = "1 day") -> DataFrame:
    """Rows (with ts) that a micro-batch takes up again: those since the last one, less an overlap for late ones."""
    return rows.filter(F.col("ts") >= since - F.expr(f"INTERVAL {overlap}"))


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap; state older than the watermark is dropped, and so are rows later than it."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("event_count"))
    return own.select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "event_count")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All input that there is, then stop; the result as a table in the shared folder. Each micro-batch writes it whole (complete) or its own rows (append, update)."""
    path = shared_folder(stream.sparkSession, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/version={n}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    table = stream.sparkSession.read.parquet(f"{path}/table")
    if mode == "complete":
        table = table.filter(F.col("version") == table.agg(F.max("version")).head()[0])
    return table.drop("version")
