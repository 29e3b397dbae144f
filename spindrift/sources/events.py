"""Event log: JSON payloads as typed rows, and rows as payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

TEXT_FIELDS = (
    "event_type", "user_id", "session_id", "endpoint", "query_text", "kind", "format", "phase", "study_type", "promoted_alias", "promoted_canonical", "correction_text",
)
NUMBER_FIELDS = ("num_sources", "latency_ms", "turn_number")


def typed(log: DataFrame, payload: str = "text_payload", ts: str = "timestamp") -> DataFrame:
    """timestamp, 12 text fields, 3 whole numbers (null if they are none), raw; rows without an event type are dropped."""
    get = lambda f: F.get_json_object(payload, f"$.{f}")
    return log.select(
        F.col(ts).alias("timestamp"), *[get(f).alias(f) for f in TEXT_FIELDS], *[get(f).try_cast("bigint").alias(f) for f in NUMBER_FIELDS], F.col(payload).alias("raw")
    ).filter("event_type IS NOT NULL")


def payload(fields: dict[str, Column], texts: tuple[str, ...] = ("query_text", "correction_text", "answer_text"), most: int = 2000) -> Column:
    """Fields as JSON without those that are null; long texts are cut and marked."""
    return F.to_json(F.struct(*[(X.shortened(c, most) if n in texts else c).alias(n) for n, c in fields.items()]))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback log, one JSON row a line, newest first; broken lines are dropped."""
    schema = (
        "id string, created_at string, status string, type string, reason string, correction_kind string, alias string, canonical string, notes string, "
        "context struct<query: string, assistant_message: string, source_nct_ids: array<string>>"
    )
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("created_at"), F.desc("id"))


def aliases_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """alias, canonical from JSON objects; aliases lower-cased and trimmed, empty ones dropped."""
    pairs = texts.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    return pairs.select(X.cleaned(F.lower("k")).alias("alias"), X.cleaned(F.col("v")).alias("canonical")).filter("alias <> '' AND canonical <> ''").dropDuplicates(["alias"])
