"""Registered queries over tables that streams and updates keep: sessions, scores, changed documents, vectors.

Each takes a given table as its input, delivers it in several files as it would come in (late rows, rows that come again), and
keeps a table from them in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback, landscape, merge
from ..operators.store import BucketStore, refresh
from ..sources import files, order
from ..sources.files import shared_folder
from ..streaming import sessions
from ..streaming.keyed import KeyedTable, latest
from .catalog import _VOTES_SQL, NOW, _votes, query, table


def delivered(rows: DataFrame, turns: Column, n: int, name: str) -> tuple[str, str]:
    """(folder of its own, folder below it with rows in n deliveries): turns is an array of the numbers of a row's deliveries."""
    path = shared_folder(rows.sparkSession, f"{name}-{uuid.uuid4().hex}")
    told = rows.withColumn("_files", turns)
    for i in range(n):
        told.filter(F.array_contains("_files", i)).drop("_files").write.mode("append").parquet(f"{path}/in")
    return path, f"{path}/in"


def streamed(spark: SparkSession, path: str, like: DataFrame, n: int, per_batch: int = 2) -> DataFrame:
    """The n deliveries below path, about `per_batch` of them in a micro-batch, in however many files each came: there are no more micro-batches for a larger table."""
    landed = sum(x.endswith(".parquet") for x in files.names(spark, path))
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max(1, -(-landed * per_batch // n))).parquet(path)


def _by_time(ts: Column, first: str, days: int, n: int, number: Column) -> Column:
    """Deliveries by time, `days` each; one row in eleven comes a delivery late, one in thirteen comes twice."""
    own = F.least(F.floor(F.datediff(ts, F.lit(first).cast("date")) / days), F.lit(n - 1)).cast("int")
    later = F.least(own + 1, F.lit(n - 1))
    return F.when(number % 13 == 0, F.array_distinct(F.array(own, later))).when(number % 11 == 0, F.array(later)).otherwise(F.array(own))


def _sessions(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    path, landed = delivered(events, _by_time(F.col("ts"), "2024-01-01", 8, 4, F.col("event_id")), 4, f"kept-{key}")
    stream = sessions.without_repeats(streamed(spark, landed, events, 4), ["event_id"], "20 days")
    made = sessions.kept_sessions(stream, key, path, keep_hours=24 * 20, late_hours=24 * 20)
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_active_at")})


@query("""SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, CAST(max_by(user_id, ts) AS VARCHAR) AS user_id, min(ts) AS started_at, max(ts) AS last_active_at,
count(*) AS event_count, list_sort(list(DISTINCT event_type)) AS features_used FROM events GROUP BY 1""")
def sessions_keyed_state(spark, sf_dir):
    """Sessions from keyed state over four deliveries with late and repeated rows: equal to the batch roll-up."""
    return _sessions(spark, sf_dir, "session_id")


@query("SELECT user_id, min(ts) AS started_at, max(ts) AS last_active_at, count(*) AS event_count, list_sort(list(DISTINCT event_type)) AS features_used FROM events GROUP BY 1")
def stream_sessions_available_now(spark, sf_dir):
    return _sessions(spark, sf_dir, "user_id")


@query(f"WITH {_VOTES_SQL} SELECT doc_id, round(net, 6) AS net FROM net")
def feedback_scores_kept(spark, sf_dir):
    """Decayed scores that are kept as mergeable sums: three deliveries of votes, read at a time that comes later."""
    votes = _votes(spark, sf_dir)
    path, landed = delivered(votes, F.array((F.col("doc_id") % 3).cast("int")), 3, "kept-scores")
    kept = KeyedTable(spark, f"{path}/scores", feedback.merged_parts, compact_every=2)
    kept.run(streamed(spark, landed, votes, 3, per_batch=1), "append", each=feedback.score_parts)
    return feedback.scores_at(kept.read(), F.lit(NOW).cast("timestamp")).select("doc_id", F.round("net", 6).alias("net"))


_REVISED = "d AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS updated, text FROM documents UNION ALL SELECT doc_id, DATE '2024-01-06' + CAST(doc_id % 30 AS INTEGER), text || ' (revised)' FROM documents WHERE doc_id % 7 = 0)"


def revisions(docs: DataFrame) -> DataFrame:
    """doc_id, updated, text: every document, and every seventh again five days later."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    first = docs.select("doc_id", day.alias("updated"), "text")
    again = first.filter("doc_id % 7 = 0").select("doc_id", F.date_add("updated", 5).alias("updated"), F.concat("text", F.lit(" (revised)")).alias("text"))
    return first.unionByName(again)


def landed_documents(spark: SparkSession, sf_dir: str, order: list[int]) -> DataFrame:
    """The last revision of each document, kept from deliveries that each repeat the last three days of the one before; order: in which these come."""
    rows = revisions(table(spark, sf_dir, "documents")).withColumn("ts", F.col("updated").cast("timestamp"))
    day, n = F.datediff("updated", F.lit("2024-01-01").cast("date")), len(order)
    own, next_one = F.least(F.floor(day / 9), F.lit(n - 1)).cast("int"), F.least(F.floor((day + 3) / 9), F.lit(n - 1)).cast("int")
    places = F.array(*[F.lit(order.index(i)) for i in range(n)])
    path, landed = delivered(rows, F.array_distinct(F.array(places[own], places[next_one])), n, "kept-documents")
    kept = KeyedTable(spark, f"{path}/documents", latest(["doc_id"], "updated"))
    kept.run(sessions.without_repeats(streamed(spark, landed, rows, n), ["doc_id", "updated"], "60 days"), "append", each=lambda batch: kept.merge(batch.drop("ts")))
    return kept.read()


@query(f"WITH {_REVISED} SELECT doc_id, CAST(max(updated) AS VARCHAR) AS updated, substr(sha256(max_by(text, updated)), 1, 16) AS text_hash FROM d GROUP BY 1")
def documents_landed_twice(spark, sf_dir):
    return landed_documents(spark, sf_dir, [0, 1, 2, 3]).select("doc_id", F.col("updated").cast("string").alias("updated"), merge.text_hash(F.col("text")).alias("text_hash"))


# Tables that updates keep.


def text_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, embedding of (doc_id, text, text_hash): three plain measures of a text stand for an encoder."""
    measures = [F.char_length("text"), F.char_length(F.translate("text", " ", "")), F.char_length(F.regexp_replace("text", "[^\\n]", ""))]
    return docs.select("doc_id", "text_hash", F.array(*[m.cast("float") for m in measures]).alias("embedding"))


def stored_vectors(spark: SparkSession, sf_dir: str, path: str, buckets: int = 32) -> tuple[BucketStore, DataFrame]:
    """(store of the documents but every tenth, which came later; the documents as they are now: one in ten is revised and one in ten is gone)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = docs.filter("doc_id % 10 <> 1").withColumn("text_hash", merge.text_hash(F.col("text")))
    store = BucketStore(spark, path, "doc_id", buckets)
    store.create(text_vectors(before))
    text = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return store, docs.filter("doc_id % 10 <> 5").withColumn("text", text)


@query("""
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' (revised)' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 5)
SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash, CAST(length(text) AS FLOAT) AS chars, CAST(length(replace(text, ' ', '')) AS FLOAT) AS inked, CAST(length(text) - length(replace(text, chr(10), '')) AS FLOAT) AS lines FROM n
""")
def embedding_store_update(spark, sf_dir):
    """A written store brought up to date: changed and new texts are encoded, vectors of documents that are gone go."""
    store, now = stored_vectors(spark, sf_dir, shared_folder(spark, f"vectors-{uuid.uuid4().hex}"))
    refresh(store, now, text_vectors)
    e = F.col("embedding")
    return store.read().select("doc_id", "text_hash", e[0].alias("chars"), e[1].alias("inked"), e[2].alias("lines"))


@query("""
WITH i AS (SELECT doc_id // 2 AS key, 'w' || CAST(n_chars AS VARCHAR) AS value, doc_id FROM documents), l AS (SELECT key, max_by(value, doc_id) AS value FROM i GROUP BY key)
SELECT doc_id AS key, coalesce(value, lang) AS value FROM documents LEFT JOIN l ON key = doc_id
""")
def upsert_in_reading_order(spark, sf_dir):
    """Rows that repeat within what comes in: the last one read counts, however they are dealt out before the upsert."""
    docs = table(spark, sf_dir, "documents")
    path = shared_folder(spark, f"incoming-{uuid.uuid4().hex}")
    docs.select(F.floor(F.col("doc_id") / 2).alias("key"), F.concat(F.lit("w"), F.col("n_chars").cast("string")).alias("value"), "doc_id").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.parquet(path)
    incoming = order.read(spark, path).repartition(5, "value")
    return merge.upserted(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("value")), incoming, "key")


@query("""
SELECT CAST(n_chars % 97 AS VARCHAR) AS label, count(*) AS count FROM (SELECT n_chars, row_number() OVER () AS pos FROM documents) GROUP BY 1 ORDER BY 2 DESC, min(pos) LIMIT 20
""")
def landscape_first_seen(spark, sf_dir):
    """Labels by count; of equally frequent ones those that are read first."""
    docs = order.read(spark, f"{sf_dir}/documents.parquet")
    return landscape.distribution(docs.select("n_chars", "pos").repartition(7, "n_chars"), (F.col("n_chars") % 97).cast("string"), top=20, order=F.col("pos"))
