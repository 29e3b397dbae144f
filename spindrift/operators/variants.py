"""Nested values of any shape, as VARIANT columns: their leaves by path, and what differs between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep values are taken apart; what is nested deeper counts as one leaf, as JSON.
DEPTH = 8
#: Versions whose leaves one task sorts, about.
VERSIONS_PER_TASK = 50_000


def _container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)<[^>]")


def shown(v: Column) -> Column:
    """A value as text: plain ones as they are, an empty list or struct as [] or {}, a null as null."""
    return F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def leaves(rows: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """The other columns of rows, path, value: one row for each plain value, whatever fields there are.

    Each level is one lateral explode that leaves plain values as they are, so the plan is a chain of narrow steps: no shuffle, and
    rows are read once.
    """
    spark = rows.sparkSession
    keys = [c for c in rows.columns if c != column]
    at = rows.select(*keys, F.lit("$").alias("path"), F.col(column).alias("_v"))
    for _ in range(depth):
        inner = F.when(_container(F.col("_v")), F.col("_v"))
        at = at.withColumn("_c", inner).lateralJoin(spark.tvf.variant_explode_outer(F.col("_c").outer()))
        whole = F.col("pos").isNull()  # a plain value, or a list without anything in it
        step = F.when(whole, "").when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        at = at.select(*keys, F.concat("path", step).alias("path"), F.when(whole, F.col("_v")).otherwise(F.col("value")).alias("_v"))
    return at.select(*keys, "path", shown(F.col("_v")).alias("value"))


def diff(versions: DataFrame, keys: list[str], column: str = "body", version: str = "version", depth: int = DEPTH, per_task: int = VERSIONS_PER_TASK) -> DataFrame:
    """keys, version, path, change (added, dropped, changed), value_a, value_b: what differs between each version and the one numbered before it.

    Each version meets its predecessor once, before values are taken apart, and both sides' leaves meet by path where they are, so fields that only
    one of them has need no list of fields, and leaves are never shuffled. A task sorts the leaves of about `per_task` versions, however many there are.
    A version whose predecessor isn't there has no rows.
    """
    n = -(-versions.count() // per_task)
    # a join takes the session's number of partitions, merged by their bytes, in place of a smaller one
    n = max(n, int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > 1 else 1
    now = versions.select(*keys, version, F.col(column).alias("_b")).repartition(n, *keys, version)
    before = versions.select(*keys, (F.col(version) + 1).alias(version), F.col(column).alias("_a")).repartition(n, *keys, version)
    side = lambda name, of: F.struct(F.lit(name).alias("side"), F.col(of).alias("value"))
    sides = now.join(before, [*keys, version]).select(*keys, version, F.inline(F.array(side("a", "_a"), side("b", "_b")))).withColumnRenamed("value", column)
    told = leaves(sides, column, depth).groupBy(*keys, version, "path").agg(
        *[F.max(F.when(F.col("side") == s, F.col("value"))).alias(f"value_{s}") for s in "ab"], *[F.max((F.col("side") == s).cast("int")).alias(f"in_{s}") for s in "ab"]
    )
    change = F.when(F.col("in_a") == 0, "added").when(F.col("in_b") == 0, "dropped").when(~F.col("value_a").eqNullSafe(F.col("value_b")), "changed")
    return told.withColumn("change", change).filter("change IS NOT NULL").select(*keys, version, "path", "change", "value_a", "value_b")


def field_text(v: Column) -> Column:
    """A field as it is displayed: a list of plain values as lines with bullets, a struct as lines "name: value", a plain value as it is."""
    kind = F.schema_of_variant(v)
    items = F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string, string>"), F.create_map().cast("map<string,string>")))
    told = F.array_sort(F.transform(F.filter(pairs, lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))))
    return F.when(kind.startswith("ARRAY"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("• "), x)), "\n")).when(kind.startswith("OBJECT"), F.array_join(told, "\n")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
