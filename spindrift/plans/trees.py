"""Registered queries over nested versions, trailing windows and hash trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import trees, variants, windows
from .catalog import _EVENTS_SQL, _SNAPSHOT_SQL, _VERSIONS_SQL, _events, _snapshots, query, table


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, protocol_id, version, body: a customer's orders as versions of a nested protocol whose fields come and go, as JSON text."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    arms: Column = F.filter(F.array(F.lit("A"), F.when(k % 3 == 0, "B"), F.when(k % 9 == 0, "C")), lambda x: x.isNotNull())
    body = F.struct(
        F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("phase"),
        F.struct(F.round(F.col("o_totalprice")).cast("long").alias("planned"), arms.alias("arms")).alias("enrollment"),
        F.array(F.struct(F.concat(F.lit("c"), (k % 4).cast("string")).alias("country"), F.when(k % 2 == 0, k % 5).alias("beds"))).alias("sites"),
        F.when(k % 2 == 0, "ALL").alias("sex"),
    )
    return o.select((F.col("o_custkey") % 10).cast("string").alias("user_id"), F.col("o_custkey").alias("protocol_id"), version.alias("version"), F.to_json(body).alias("body"))


_LEAVES_SQL = f"""{_VERSIONS_SQL}, k AS (SELECT o_custkey AS protocol_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version, o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS phase, o_totalprice AS price FROM orders),
l AS (SELECT protocol_id, version, '$.title' AS path, title AS value FROM k UNION ALL SELECT protocol_id, version, '$.phase', phase FROM k UNION ALL SELECT protocol_id, version, '$.enrollment.planned', CAST(CAST(round(price) AS BIGINT) AS VARCHAR) FROM k
  UNION ALL SELECT protocol_id, version, '$.enrollment.arms[0]', 'A' FROM k UNION ALL SELECT protocol_id, version, '$.enrollment.arms[1]', 'B' FROM k WHERE k % 3 = 0 UNION ALL SELECT protocol_id, version, '$.enrollment.arms[2]', 'C' FROM k WHERE k % 9 = 0
  UNION ALL SELECT protocol_id, version, '$.sites[0].country', 'c' || CAST(k % 4 AS VARCHAR) FROM k UNION ALL SELECT protocol_id, version, '$.sites[0].beds', CAST(k % 5 AS VARCHAR) FROM k WHERE k % 2 = 0 UNION ALL SELECT protocol_id, version, '$.sex', 'ALL' FROM k WHERE k % 2 = 0)"""


@query(f"WITH {_LEAVES_SQL} SELECT protocol_id, version, path, value FROM l")
def protocol_leaves(spark, sf_dir):
    """Every plain value of every version, by path."""
    rows = protocols(spark, sf_dir).select("protocol_id", "version", F.parse_json("body").alias("body"))
    return variants.leaves(rows, "body")


@query(f"""WITH {_LEAVES_SQL}, j AS (SELECT coalesce(b.protocol_id, a.protocol_id) AS protocol_id, coalesce(b.version, a.version + 1) AS version, coalesce(b.path, a.path) AS path, a.value AS value_a, b.value AS value_b, a.path IS NULL AS no_a, b.path IS NULL AS no_b
  FROM l a FULL JOIN l b ON a.protocol_id = b.protocol_id AND a.version + 1 = b.version AND a.path = b.path)
SELECT protocol_id, version, path, CASE WHEN no_a THEN 'added' WHEN no_b THEN 'dropped' ELSE 'changed' END AS change, value_a, value_b FROM j JOIN (SELECT protocol_id, max(version) AS last FROM k GROUP BY 1) USING (protocol_id)
WHERE version BETWEEN 2 AND last AND (no_a OR no_b OR value_a <> value_b)""")
def protocol_diff(spark, sf_dir):
    """What differs between each version and the one before, by path, over whatever fields there are."""
    rows = protocols(spark, sf_dir).select("protocol_id", "version", F.parse_json("body").alias("body"))
    return variants.diff(rows, ["protocol_id"])


@query("SELECT event_type, '$.' || key AS path, json_extract_string(props, '$.' || key) AS value, count(*) AS n FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2, 3")
def event_properties(spark, sf_dir):
    """Values of whatever properties events have, by path."""
    rows = table(spark, sf_dir, "events").select("event_type", F.try_parse_json("props").alias("props"))
    return variants.leaves(rows, "props").filter("value IS NOT NULL OR path <> '$'").groupBy("event_type", "path", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EVENTS_SQL}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS until FROM e),
w AS (SELECT until, e.* FROM d JOIN e ON CAST(ts AS DATE) BETWEEN until - INTERVAL 6 DAY AND until)
SELECT CAST(until AS VARCHAR) AS until, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions FROM w GROUP BY 1""")
def trailing_users(spark, sf_dir):
    """Distinct users and sessions of the week that ends with each day, from daily bitmaps."""
    events = _events(spark, sf_dir).withColumn("user_no", F.col("user_id").cast("long"))
    users = windows.trailing_distinct(windows.daily_distinct(events, "user_no", []), [])
    sessions = windows.trailing_distinct(windows.daily_distinct(windows.numbered(events, "session_id", "session_no"), "session_no", []), [])
    return users.withColumnRenamed("n", "users").join(sessions.withColumnRenamed("n", "sessions"), "until").select(F.col("until").cast("string").alias("until"), "users", "sessions")


@query()
def trailing_latency(spark, sf_dir):
    """p50 and p95 of the week that ends with each day by endpoint, from daily quantile sketches. Approximate, so without SQL; ranks are tested."""
    rolled = windows.daily_latency(_events(spark, sf_dir), ["endpoint"])
    return windows.trailing_latency(rolled, ["endpoint"])


@query(f"""WITH {_SNAPSHOT_SQL}, m AS (SELECT doc_id, coalesce(new.text, old.text) AS text, coalesce(new.lang, old.lang) AS lang FROM old FULL JOIN new USING (doc_id) WHERE doc_id % 10 <> 7)
SELECT doc_id AS id, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN m.doc_id IS NULL THEN 'dropped' ELSE 'changed' END AS change FROM old FULL JOIN m USING (doc_id) WHERE old.doc_id IS NULL OR m.doc_id IS NULL OR old.text <> m.text OR old.lang IS DISTINCT FROM m.lang""")
def snapshot_differences(spark, sf_dir):
    """Ids that differ between a snapshot and the one after an update, by hash trees."""
    from ..operators import merge

    old, new = _snapshots(spark, sf_dir)
    now = merge.upserted(old, new, "doc_id").filter("doc_id % 10 <> 7")
    return trees.differing(*(trees.built(rows, "doc_id", ["text", "lang"], leaf=16, fanout=8, levels=3) for rows in (old, now)))
