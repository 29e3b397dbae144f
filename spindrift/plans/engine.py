"""One object for an application: search, chat retrieval, landscape, corpora, protocols, feedback.

Text generation is not part of it; answers start from the DataFrames returned here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import documents, evaluation, feedback, landscape, merge, reports, retrieval, versions
from ..operators.dictionary import expanded
from ..operators.store import BucketStore
from ..sources.files import staged
from ..sources.order import PLACE


@dataclass
class Wanted:
    """What a query's text asks for."""

    countries: list[str] = field(default_factory=list)
    states: list[str] = field(default_factory=list)
    setting: str | None = None
    study_type: str | None = None
    statuses: list[str] = field(default_factory=list)
    sponsors: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)

    def attributes(self) -> bool:
        return bool(self.study_type or self.statuses or self.sponsors or self.classes)

    def any(self) -> bool:
        return self.attributes() or bool(self.countries or self.states or self.setting)

    def predicate(self) -> Column:
        """All but the classes, over build_documents()."""
        keep = F.lit(True)
        if self.countries:
            keep &= X.holds_any(F.col("locationCountries"), self.countries)
        if self.states:
            keep &= X.holds_any(F.coalesce(X.or_null(F.col("locationInfoFull")), F.col("locationInfo")), self.states)
        if self.setting:
            keep &= X.matches_setting(documents.setting_text(), self.setting)
        if self.study_type:
            keep &= F.upper("studyType") == self.study_type
        if self.statuses:
            keep &= F.upper("status").isin(self.statuses)
        if self.sponsors:
            keep &= X.holds_any(F.col("sponsorName"), self.sponsors)
        return keep


def wanted(spark: SparkSession, query: str) -> tuple[Wanted, str]:
    """The filters of one query text and the text widened by its classes' drugs: one row, computed by the expressions that batches use."""
    row = spark.range(1).select(F.lit(query).alias("q")).select(
        X.countries(F.col("q")).alias("countries"), X.states(F.col("q")).alias("states"), X.setting_intent(F.col("q")).alias("setting"), X.study_type(F.col("q")).alias("study_type"),
        X.statuses(F.col("q")).alias("statuses"), X.sponsors(F.col("q")).alias("sponsors"), X.drug_classes_named(F.col("q")).alias("classes"),
        X.with_drugs(F.col("q"), X.drug_classes_named(F.col("q"))).alias("widened"),
    ).head()
    got = row.asDict()
    widened = got.pop("widened")
    return Wanted(**got), widened


class Engine:
    """docs: build_documents(); postings and terms of their text are made once and kept by Spark."""

    def __init__(self, docs: DataFrame, most_terms: int = 10_000, stop_words: list[str] | None = None):
        docs = docs.cache()
        self.spark, self.docs, self.how = docs.sparkSession, docs, {"stop_words": stop_words, "bigrams": True}
        counts = retrieval.term_counts(docs, "doc_id", "text", **self.how)
        self.terms = retrieval.vocabulary(counts, docs.count(), most_terms).cache()
        self.postings = retrieval.weighted(counts, self.terms).cache()

    def _scored(self, query: str, k: int) -> DataFrame:
        """The k best documents, rank 1 first."""
        asked = retrieval.term_counts(self.spark.createDataFrame([("q", query)], "id string, text string"), "id", "text", **self.how)
        best = retrieval.sparse_scores(retrieval.weighted(asked, self.terms), self.postings)
        return retrieval.top_k(best, k).drop("qid").join(self.docs, "doc_id")

    def search(self, query: str, k: int = 5, scores: DataFrame | None = None) -> DataFrame:
        """k documents with score and rank. The pool is scored, then filtered; filters that leave nothing are dropped."""
        if not 1 <= k <= CHAT_MOST:
            raise ValueError(f"k must be 1 to {CHAT_MOST}")
        return self._retrieved(query, k, scores)

    def _retrieved(self, query: str, k: int, scores: DataFrame | None) -> DataFrame:
        """The k best of a pool that meet all filters of the query; classes all, else any, else the other filters alone; the whole pool if nothing meets those."""
        want, widened = wanted(self.spark, query)
        pool = self._scored(widened if want.any() else query, retrieval.pool_size(k, want.attributes(), want.any(), scores is not None))
        if want.any():
            own = want.predicate()
            classes = [X.has_all(F.col("drug_classes"), want.classes), X.has_any(F.col("drug_classes"), want.classes)] if want.classes else []
            pool = retrieval.filter_ladder(pool, *[own & c for c in classes], own)
        return self._ordered(pool, scores).limit(k)

    @staticmethod
    def _ordered(pool: DataFrame, scores: DataFrame | None) -> DataFrame:
        return feedback.reranked(pool, scores) if scores is not None else pool.orderBy("rank")

    def chat(self, query: str, filters: dict[str, str | None], k: int = 5, with_landscape: bool = True, aliases: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
        """Documents of a chat turn: a wide pool spread over drug classes when a population is known, else search; industry and recruiting trials first."""
        asked = self.spark.range(1).select(X.with_population(F.lit(query), F.lit(filters.get("disease") or "")).alias("q"))
        if aliases is not None:
            asked = expanded(asked.withColumn("id", F.lit(0)), "id", "q", aliases).select(F.col("widened").alias("q"))
        query = asked.head()[0]
        if with_landscape and filters.get("disease"):
            pool = self._retrieved(query, K.CHAT_POOL, scores)
            keep = F.lit(True)
            if filters.get("phase"):
                keep &= X.cleaned(F.col("phases")) == filters["phase"]
            if filters.get("status"):
                keep &= X.cleaned(F.col("status")) == filters["status"]
            pool = retrieval.filter_ladder(pool, keep).withColumn("qid", F.lit(0)).withColumnRenamed("drug_classes", "classes")
            place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank")).alias("rank")
            found = retrieval.diversified(pool.select(*[c for c in pool.columns if c != "rank"], place), K.CHAT_BUDGET).drop("qid").withColumnRenamed("classes", "drug_classes")
        else:
            found = self._retrieved(query, k, scores)
        tiers = [F.when(X.cleaned(F.col("sponsorClass")) == "INDUSTRY", 0).otherwise(1), F.when(X.cleaned(F.col("status")) == "RECRUITING", 0).otherwise(1)]
        return found.orderBy(*tiers, F.desc("score"), "rank")

    def evaluate(self, cases: DataFrame, k: int = 10) -> DataFrame:
        """Means by category and overall of cases (query_id, query, category, keywords, expected_ids), searched as one batch without filters."""
        asked = retrieval.term_counts(cases, "query_id", "query", **self.how)
        top = retrieval.top_k(retrieval.sparse_scores(retrieval.weighted(asked, self.terms), self.postings), k)
        rows = top.join(self.docs.drop("score", "rank"), "doc_id").join(cases.select(F.col("query_id").alias("qid"), "keywords", "expected_ids"), "qid")
        scored = evaluation.judged_by_query(rows, ["qid"], F.col("text"), F.to_json(F.struct("title", "conditions", "interventionName", "phases", "status", "sponsorName", "locationCountries")))
        every = cases.select(F.col("query_id").alias("qid"), "category").join(scored, "qid", "left").fillna(0, ["hit", "rr", "precision"])
        return evaluation.macro(every)

    @staticmethod
    def report(events: DataFrame, now: Column) -> dict[str, DataFrame]:
        """The weekly report's sections by name."""
        steps = {"searched": "query_received", "reached_chat": "chat_message", "generated": "protocol_generated", "refined": "protocol_refined"}
        return {
            "headline": reports.headline(events, now), "users": reports.new_and_returning(events, now), "funnel": reports.funnel(events, now, steps), "quality": reports.quality(events, now),
            "zero_results": reports.top_texts(events, now, (F.col("event_type") == "query_received") & (F.col("num_sources") == 0), "occurrences"),
            "bad_answers": reports.top_texts(events, now, (F.col("event_type") == "feedback_submitted") & (F.col("kind") == "rating_down"), "thumbs_down_count"),
            "latency": reports.latency(events, now),
        }

    @staticmethod
    def ingest(store: BucketStore, incoming: DataFrame, by: str = PLACE) -> dict[str, int]:
        """Bring a stored snapshot up to date with incoming rows, of which the last of each key by `by` counts: n_new, n_updated, total. Only touched buckets are written."""
        stored = store.read()
        last = staged(merge.last_by_key(incoming, store.key, by), "incoming-last")
        counts = merge.change_counts(merge.changes(stored, last, store.key)).head().asDict()
        kinds = {f.name: f.dataType for f in stored.schema.fields}
        told = merge.changes(stored, last, store.key).filter("change IN ('I', 'U')").select(store.key)
        store.update(staged(last.join(told, store.key, "left_semi").select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in stored.columns]), "incoming-changed"))
        return counts

    def landscape(self, filters: dict[str, str | None]) -> DataFrame:
        pattern = dict(K.DISEASES).get(filters.get("disease") or "")
        return landscape.landscape(self.docs, pattern, filters.get("phase"), filters.get("status"))

    @staticmethod
    def corpora(spark: SparkSession, trials: DataFrame) -> DataFrame:
        """Every known corpus with its number of trials, null if it is not loaded; trials has corpus."""
        known = spark.createDataFrame(K.CORPORA, "corpus string, display_name string, condition string")
        counts = trials.groupBy("corpus").agg(F.count(F.lit(1)).alias("trial_count"))
        return known.join(counts, "corpus", "left").withColumn("loaded", F.col("trial_count").isNotNull())

    @staticmethod
    def health(corpora: DataFrame) -> DataFrame:
        """trials of all loaded corpora, and how many corpora are loaded and known."""
        return corpora.agg(F.coalesce(F.sum("trial_count"), F.lit(0)).alias("trials"), F.count_if("loaded").alias("loaded"), F.count(F.lit(1)).alias("known"))

    @staticmethod
    def of_enabled(rows: DataFrame, corpora: DataFrame, column: str = "corpus") -> DataFrame:
        """rows whose corpus is loaded; one that isn't is an error, which names it."""
        missing = rows.select(column).distinct().join(corpora.filter("loaded").select(F.col("corpus").alias(column)), column, "left_anti").orderBy(column).head(3)
        if missing:
            raise ValueError("corpora that are not enabled: " + ", ".join(str(r[0]) for r in missing))
        return rows


CHAT_MOST = 20


class ProtocolStore:
    """Protocol versions as rows (user_id, protocol_id, version, ts, title, …, user_request, assistant_note) of a Parquet folder by user."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # noqa: BLE001  the folder is made by the first save
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def save(self, rows: DataFrame, must_exist: bool = False) -> None:
        """Append rows as the next version of their protocols. Only the folders of the rows' users are read; a new title "Untitled protocol" keeps the one before."""
        users = [r["user_id"] for r in rows.select("user_id").distinct().collect()]  # those of one request
        stored = self.read().filter(F.col("user_id").isin(users))
        made = versions.next_versions(stored, rows.drop("version"), ["user_id", "protocol_id"])
        if "title" in made.columns:
            before = versions.latest(stored, ["user_id", "protocol_id"]).select("user_id", "protocol_id", F.col("title").alias("_title"))
            kept = F.when(F.col("title") == "Untitled protocol", F.coalesce("_title", "title")).otherwise(F.col("title"))
            made = made.join(before, ["user_id", "protocol_id"], "left").withColumn("title", kept).drop("_title")
        if must_exist and made.filter("version = 1").head(1):
            raise KeyError("unknown protocol")
        made.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]).write.mode("append").partitionBy("user_id").parquet(self.path)

    def list(self, user: str, most: int = 100) -> DataFrame:
        return versions.listed(self.read(), user, most)

    def load(self, user: str, protocol: str, version: int | None = None) -> DataFrame:
        own = self.read().filter((F.col("user_id") == user) & (F.col("protocol_id") == protocol))
        return own.filter(F.col("version") == version) if version else versions.latest(own, ["user_id", "protocol_id"])

    def matching(self, user: str, query: str, fields: list[str], most: int = 10) -> DataFrame:
        """All of a user's protocols, those that share the query's terms first, then the newest."""
        asked = self.spark.createDataFrame([(user, query)], "user_id string, query string")
        return versions.matched(self.list(user), asked, fields, most).orderBy("place")

    def create(self, rows: DataFrame, now: str) -> DataFrame:
        """Save first versions of new protocols, each with an id of its own and a first entry of its change log; returns the rows with their ids."""
        made = versions.initial(rows, now)
        held = staged(made, "protocols-new")  # ids are drawn once
        self.save(held)
        return held

def fingerprint(docs: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """n and a digest of a corpus that doesn't depend on the order of its rows: per-row hashes (longs) are combined before they are shuffled."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id", "text") if row_hash is None else row_hash).alias("digest"))


def totals(rows: DataFrame, corpus: str = "corpus") -> DataFrame:
    """corpus, trial_count: of each corpus, and of all."""
    return rows.rollup(corpus).agg(F.count(F.lit(1)).alias("trial_count"), F.grouping(corpus).alias("_all")).select(F.when(F.col("_all") == 1, "all").otherwise(F.col(corpus)).alias("corpus"), "trial_count")


class FeedbackStore:
    """Feedback as an append-only JSON log: a change of status is a new row, the last of an id counts."""

    FIELDS = "id string, created_at string, status string, type string, reason string, correction_kind string, alias string, canonical string, notes string, context struct<query: string, assistant_message: string, source_nct_ids: array<string>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame, now: str) -> None:
        names = [c.split(" ")[0] for c in self.FIELDS.split(", context")[0].split(", ")]
        blank = {"id": F.uuid(), "created_at": F.lit(now), "status": F.lit("open")}
        cols = [F.coalesce(F.col(n), blank[n]).alias(n) if n in rows.columns and n in blank else F.col(n) if n in rows.columns else blank.get(n, F.lit(None).cast("string")).alias(n) for n in names]
        rows.select(*cols, *(["context"] if "context" in rows.columns else [])).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        log = self.spark.read.schema(self.FIELDS).option("mode", "DROPMALFORMED").json(self.path)
        return feedback.latest_status(log).orderBy(F.desc("created_at"), "id")

    def promote(self, id_: str, aliases: DataFrame, now: str, store: Callable[[DataFrame], None]) -> DataFrame | None:
        """Store the alias of a feedback row, then resolve the row: a failure between the two leaves it open, and it can be promoted again. The aliases, or None if there is no such row or it names none."""
        row = self.read().filter((F.col("id") == id_) & (X.cleaned(F.col("alias")) != "") & (X.cleaned(F.col("canonical")) != "")).head()
        if row is None:
            return None
        made = feedback.upserted_alias(aliases, row["alias"], row["canonical"])
        store(made)
        self.set_status(id_, "resolved", now)
        return made

    def set_status(self, id_: str, status: str, now: str) -> bool:
        """False if there is no such id."""
        if status not in ("open", "resolved", "dismissed"):
            raise ValueError(status)
        row = self.read().filter(F.col("id") == id_)
        if not row.head(1):
            return False
        row.withColumn("status", F.lit(status)).withColumn("created_at", F.lit(now)).write.mode("append").json(self.path)
        return True
