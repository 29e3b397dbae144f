"""A token-paginated source, as it is landed: a batch and a stream reader with pages as partitions and filters that skip pages.

A landed folder holds `pages/page=<n>/`, each with one page as JSON (studies, nextPageToken), and `index/`, which tells for each page
how many studies it has and the least and largest value of its columns. Filters that Spark pushes down are compared with the
index, so a page that can't hold a match is not read; Spark applies them to the rows of the others again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from .files import staged

NAME = "landed_pages"


def land(rows: DataFrame, path: str, order: list[str], per_page: int, first_page: int = 0) -> None:
    """Write rows as pages of at most `per_page` in this order, numbered from first_page on, with their index, as a download job lands them.

    Rows are dealt by ranges of the order; each range has pages of its own, so the last one of a range may be shorter.
    """
    at = F.monotonically_increasing_id()
    held = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(at, 33).cast("int"), "_chunk": F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / per_page).cast("int")}), "landed-rows")
    before, offsets = first_page, []
    for part, chunks in sorted(map(tuple, held.groupBy("_part").agg(F.max("_chunk") + 1).collect())):  # a row per range
        offsets.append((part, before))
        before += chunks
    told = held.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _before int")), "_part").withColumn("page", F.col("_before") + F.col("_chunk")).drop("_part", "_chunk", "_before")
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "double", "date")]
    studies = F.sort_array(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in order])))
    more = F.when(F.col("page") < before - 1, F.concat(F.lit("token-"), (F.col("page") + 1).cast("string")))
    pages = told.groupBy("page").agg(studies.alias("studies")).select("page", F.to_json(F.struct("studies", more.alias("nextPageToken"))).alias("value"))
    pages.repartition("page").write.mode("append").partitionBy("page").text(f"{path}/pages")
    bounds = [f(F.col(c)).alias(f"{kind}_{c}") for c in plain for kind, f in (("least", F.min), ("most", F.max))]
    told.groupBy("page").agg(F.count(F.lit(1)).alias("n"), *bounds).write.mode("append").json(f"{path}/index")


def _files(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _texts(path: str) -> Iterator[str]:
    """Lines of all files of a folder, by name; none if there is no such folder."""
    from pyarrow import fs

    system, top = _files(path)
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and not f.base_name.startswith(("_", ".")):
            with system.open_input_stream(f.path) as opened:
                yield from opened.read().decode().splitlines()


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def _rows(path: str, schema: StructType, number: int) -> Iterator[tuple]:
    names = schema.fieldNames()
    for line in _texts(f"{path}/pages/page={number}"):
        for study in json.loads(line)["studies"]:
            yield tuple(study.get(n) for n in names)


def _may_hold(page: dict, f) -> bool:
    """Whether a page may hold a row that meets the filter."""
    if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) or len(f.attribute) != 1:
        return True
    column = f.attribute[0]
    if f"least_{column}" not in page:  # bounds are left out where a page has only nulls, which meet no comparison
        return f"most_{column}" in page
    least, most = page[f"least_{column}"], page[f"most_{column}"]
    if isinstance(f, In):
        return any(v is not None and least <= v <= most for v in f.value)
    if f.value is None or not isinstance(f.value, type(least)) and not (isinstance(f.value, (int, float)) and isinstance(least, (int, float))):
        return True
    return {
        EqualTo: lambda v: least <= v <= most, GreaterThan: lambda v: most > v, GreaterThanOrEqual: lambda v: most >= v, LessThan: lambda v: least < v, LessThanOrEqual: lambda v: least <= v,
    }[type(f)](f.value)


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.own, self.filters = path, schema, []

    def pushFilters(self, filters):  # noqa: N802  a name of the interface
        self.filters = list(filters)
        yield from self.filters  # Spark applies all of them to what is read

    def partitions(self):
        pages = [json.loads(line) for line in _texts(f"{self.path}/index")]
        return [Page(p["page"]) for p in sorted(pages, key=lambda p: p["page"]) if all(_may_hold(p, f) for f in self.filters)]

    def read(self, partition):
        if partition is not None:  # there may be no page at all
            yield from _rows(self.path, self.own, partition.number)


class PageStream(DataSourceStreamReader):
    """Offsets are numbers of pages: a micro-batch reads the pages that were landed since."""

    def __init__(self, path: str, schema: StructType, first: int):
        self.path, self.own, self.first = path, schema, first

    def initialOffset(self):  # noqa: N802
        return {"page": self.first}

    def latestOffset(self):  # noqa: N802
        return {"page": max((json.loads(line)["page"] + 1 for line in _texts(f"{self.path}/index")), default=self.first)}

    def partitions(self, start, end):
        return [Page(n) for n in range(start["page"], end["page"])]

    def read(self, partition):
        yield from _rows(self.path, self.own, partition.number)


class LandedPages(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return self.options["columns"]

    def reader(self, schema):
        return PageReader(self.options["path"], schema)

    def streamReader(self, schema):  # noqa: N802
        return PageStream(self.options["path"], schema, int(self.options.get("firstpage", "0")))


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)


def read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The studies of all landed pages; filters on the result skip pages."""
    _registered(spark)
    return spark.read.format(NAME).option("columns", columns).load(path)


def stream(spark: SparkSession, path: str, columns: str) -> DataFrame:
    _registered(spark)
    return spark.readStream.format(NAME).option("columns", columns).load(path)
