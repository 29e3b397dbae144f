"""Registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import conversation, evaluation, feedback, landscape, merge, reports, retrieval, versions
from ..sources import events
from ..sources.files import staged
from ..streaming import sessions as streams
from .engine import fingerprint, totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tables end on 2024-01-30; reports look back from here.
NOW = "2024-01-31 00:00:00"
#: Classes of parts by patterns of their names, in place of drug classes.
PART_CLASSES = [("ring", r"\bring\b"), ("bolt or nut", r"bolt|nut"), ("coloured", r"\b(red|blue|green)\b"), ("small", r"\bsmall\b"), ("widget", "widget")]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Landscape: documents as trials, lang as status, source as sponsor.


@query("""
WITH d AS (SELECT *, regexp_matches(lower(text), 'licen[sc]ed|released') AS pop FROM documents),
     p AS (SELECT * FROM d WHERE pop),
     t AS (SELECT 'totals' AS section, 'population_total' AS label, count(*) AS n FROM p UNION ALL SELECT 'totals', 'total', count(*) FILTER (lang = 'en') FROM p),
     s AS (SELECT 'status' AS section, coalesce(nullif(trim(lang), ''), '(unspecified)') AS label, count(*) AS n FROM p GROUP BY ALL),
     o AS (SELECT 'sponsor' AS section, coalesce(nullif(trim(source), ''), '(unspecified)') AS label, count(*) AS n FROM p GROUP BY ALL ORDER BY n DESC, label LIMIT 10)
SELECT section, label, n AS count FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM o
""")
def landscape_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.lower("text").rlike("licen[sc]ed|released"))
    named = {"status": landscape.named_or_unspecified(F.col("lang")), "sponsor": landscape.named_or_unspecified(F.col("source"))}
    return landscape.sections(docs, named, F.col("lang") == "en", {"sponsor": 10})


@query("SELECT count(*) FILTER (regexp_matches(lower(text), 'licen')) AS population_total, count(*) FILTER (regexp_matches(lower(text), 'licen') AND lang = 'en') AS total FROM documents")
def landscape_totals(spark, sf_dir):
    return landscape.totals(table(spark, sf_dir, "documents"), F.lower("text").rlike("licen"), F.col("lang") == "en")


@query("SELECT coalesce(nullif(trim(lang), ''), '(unspecified)') AS label, count(*) AS count FROM documents GROUP BY 1")
def landscape_by_status(spark, sf_dir):
    return landscape.distribution(table(spark, sf_dir, "documents"), landscape.named_or_unspecified(F.col("lang")))


@query("SELECT source AS label, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def landscape_by_sponsor(spark, sf_dir):
    return landscape.distribution(table(spark, sf_dir, "documents"), F.col("source"), top=10)


@query("SELECT upper(t) AS label, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part) WHERE t <> '' GROUP BY 1")
def landscape_token_explode(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.explode(landscape.parts(F.col("p_name"), " ")).alias("t"))
    return landscape.distribution(tokens, F.upper("t"))


_CLASS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(p_name), '{p}') THEN '{n}' END" for n, p in PART_CLASSES) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT label, count(*) AS count FROM (SELECT unnest({_CLASS_SQL}) AS label FROM part) GROUP BY 1")
def landscape_class_counts(spark, sf_dir):
    classes = table(spark, sf_dir, "part").select(F.explode(X.all_matches(F.col("p_name"), PART_CLASSES)).alias("c"))
    return landscape.distribution(classes, F.col("c"), top=20)


@query("SELECT n_name AS label, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def landscape_geo_top10(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return landscape.distribution(customers, F.col("n_name"), top=10)


@query("""
SELECT p_type AS label, count(*) AS count, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM part) + 0.5) AS INTEGER) AS percent FROM part GROUP BY 1
""")
def landscape_bars(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    total = parts.agg(F.count(F.lit(1)).alias("total"))
    return landscape.distribution(parts, F.col("p_type")).crossJoin(F.broadcast(total)).select("label", "count", X.bar_percent(F.col("count"), F.col("total")).alias("percent"))


# Documents.


@query("""
SELECT c_custkey, concat_ws(chr(10), CASE WHEN trim(c_name) <> '' THEN 'Name: ' || trim(c_name) END, CASE WHEN trim(c_mktsegment) <> '' THEN 'Segment: ' || trim(c_mktsegment) END,
  CASE WHEN c_acctbal > 0 THEN 'Balance: ' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) END) AS text FROM customer
""")
def doc_text_concat(spark, sf_dir):
    from ..operators.documents import labelled_text

    rows = table(spark, sf_dir, "customer").withColumn("cents", F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100).cast("bigint")))
    return rows.select("c_custkey", labelled_text([("Name", "c_name"), ("Segment", "c_mktsegment"), ("Balance", "cents")]).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…' ELSE text END AS shown, substr(sha256(text), 1, 16) AS text_hash FROM documents")
def doc_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shortened(F.col("text"), 2000).alias("shown"), merge.text_hash(F.col("text")).alias("text_hash"))


@query("""
SELECT doc_id, regexp_matches(lower(text), '\\b(metastatic|advanced)\\b|licen') AS has_a, regexp_matches(lower(text), '\\bthe\\b') AS has_b,
  CASE WHEN regexp_matches(lower(text), 'apache') THEN 'apache' WHEN regexp_matches(lower(text), 'mit license') THEN 'mit' WHEN regexp_matches(lower(text), 'public license') THEN 'gpl' END AS first_match FROM documents
""")
def doc_setting_flags(spark, sf_dir):
    low = F.lower("text")
    kinds = [("apache", "apache"), ("mit", "mit license"), ("gpl", "public license")]
    return table(spark, sf_dir, "documents").select("doc_id", low.rlike(r"\b(metastatic|advanced)\b|licen").alias("has_a"), low.rlike(r"\bthe\b").alias("has_b"), X.first_match(F.col("text"), kinds).alias("first_match"))


@query(f"SELECT p_partkey FROM part WHERE list_has_all({_CLASS_SQL}, ['small', 'widget'])")
def doc_class_array_all(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(X.has_all(X.all_matches(F.col("p_name"), PART_CLASSES), ["small", "widget"])).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE list_has_any({_CLASS_SQL}, ['ring', 'widget'])")
def doc_class_array_any(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(X.has_any(X.all_matches(F.col("p_name"), PART_CLASSES), ["ring", "widget"])).select("p_partkey")


# Query text.


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'United States' WHEN 1 THEN 'Japan,United Kingdom' WHEN 2 THEN '' WHEN 3 THEN 'South Korea' ELSE 'West Virginia' END AS places,
  CASE n_nationkey % 3 WHEN 0 THEN 'NOT_YET_RECRUITING' WHEN 1 THEN 'RECRUITING,COMPLETED' ELSE '' END AS statuses,
  CASE n_nationkey % 4 WHEN 0 THEN 'janssen' WHEN 1 THEN 'merck' WHEN 2 THEN 'bristol' ELSE '' END AS sponsors FROM nation
""")
def extract_filters(spark, sf_dir):
    k = F.col("n_nationkey")
    pick = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), (k % n + 1).cast("int"))
    text = F.concat_ws(
        " ", pick(5, "trials in the United States of America", "British? no, UK and Japanese sites", "anywhere", "south korea only", "West Virginia clinics"),
        pick(3, "not yet recruiting", "currently recruiting or completed", "any"), pick(4, "J&J pipeline", "MSD-sponsored", "Bristol-Myers Squibb studies", "academic"),
    )
    rows = table(spark, sf_dir, "nation").withColumn("q", text)
    places = F.concat(X.countries(F.col("q")), X.states(F.col("q")))
    return rows.select("n_nationkey", F.array_join(places, ",").alias("places"), F.array_join(X.statuses(F.col("q")), ",").alias("statuses"), F.array_join(X.sponsors(F.col("q")), ",").alias("sponsors"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\blicensed under\\b') AND NOT contains(lower(text), 'permissive') THEN text || ' permissive' ELSE text END AS widened FROM documents
""")
def alias_expand(spark, sf_dir):
    aliases = F.array(F.struct(F.lit("licensed under").alias("alias"), F.lit("permissive").alias("canonical")))
    return table(spark, sf_dir, "documents").select("doc_id", X.with_aliases(F.col("text"), aliases).alias("widened"))


@query("SELECT p_brand AS canonical, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS aliases FROM part GROUP BY 1")
def alias_group(spark, sf_dir):
    return feedback.grouped_aliases(table(spark, sf_dir, "part").select(F.col("p_brand").alias("canonical"), F.col("p_type").alias("alias")))


@query("SELECT c_custkey, ['NCT' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')] AS ids FROM customer")
def nct_extract(spark, sf_dir):
    text = F.concat(F.lit("see NCT"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(" and NCT123"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.ids_named(text).alias("ids"))


# Retrieval.

_TOKENS_SQL = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))"


@query(f"SELECT term, df, cf FROM (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, {_TOKENS_SQL} AS term FROM documents) GROUP BY 1) ORDER BY cf DESC, term LIMIT 1000")
def tfidf_vocab_topn(spark, sf_dir):
    return retrieval.most_frequent(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)


_WEIGHTS_SQL = f"""
tok AS (SELECT doc_id, {_TOKENS_SQL} AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN df USING (term)), nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1)
"""


@query(f"WITH {_WEIGHTS_SQL} SELECT doc_id, round(norm, 6) AS norm FROM nrm")
def tfidf_doc_norms(spark, sf_dir):
    counts, n_docs = retrieval.counted_in_place(table(spark, sf_dir, "documents"), "doc_id", "text")
    terms = staged(retrieval.vocabulary(retrieval.listed(counts), n_docs), "terms")
    return retrieval.norms(retrieval.listed(counts), terms, n_docs).select("doc_id", F.round("norm", 6).alias("norm"))


@query(f"""
WITH {_WEIGHTS_SQL}, d AS (SELECT doc_id, term, w / norm AS w FROM raw JOIN nrm USING (doc_id)),
qtf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, {_TOKENS_SQL} AS term FROM benchmark) GROUP BY 1, 2),
qraw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN df USING (term)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qraw GROUP BY 1),
s AS (SELECT item_id AS qid, doc_id, round(sum(d.w * qraw.w / qn.norm), 6) AS score FROM qraw JOIN qn USING (item_id) JOIN d USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND score > 0
""")
def tfidf_topk_benchmark(spark, sf_dir):
    index = retrieval.indexed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.pruned_top_k(index.asked(table(spark, sf_dir, "benchmark"), "item_id", "text"), index, 5)


_COSINE = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6)"


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("v", retrieval.normalised(F.col("embedding")))
    return rows.select(F.col("vec_id").alias("doc_id"), "v", "label"), rows.select(F.col("vec_id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("q_label"))


@query(f"SELECT d.vec_id AS doc_id, {_COSINE} AS score FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE d.vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 5")
def dense_topk(spark, sf_dir):
    docs, queries = _vectors(spark, sf_dir)
    scores = retrieval.dense_scores(F.broadcast(queries.filter("qid = 0")), docs.filter("doc_id <> 0"))
    return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(5)


def _ranked(spark, sf_dir, k):
    """Every fiftieth vector is a query, against all others."""
    docs, queries = _vectors(spark, sf_dir)
    return retrieval.dense_top_k(queries.filter("qid % 50 = 0").select("qid", "q"), docs, k), docs, queries


_RANKED_SQL = f"""
s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, {_COSINE} AS score, q.label AS q_label, d.label AS label
      FROM embeddings d JOIN embeddings q ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
"""


@query(f"WITH {_RANKED_SQL} SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND score > 0")
def dense_topk_batch(spark, sf_dir):
    return _ranked(spark, sf_dir, 10)[0]


@query()
def dense_topk_lists(spark, sf_dir):
    """The ten nearest of every fiftieth vector by inverted lists, with `exact`: whether the search of all vectors finds the pair too. Approximate, so without SQL; recall is tested."""
    docs, queries = _vectors(spark, sf_dir)
    asked = queries.filter("qid % 50 = 0").select("qid", "q")
    found = retrieval.in_lists(docs.select("doc_id", "v")).top_k(asked, 10)
    exact = retrieval.dense_top_k(asked, docs, 10).select("qid", "doc_id", F.lit(True).alias("exact"))
    return found.join(exact, ["qid", "doc_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


@query(f"""
WITH {_RANKED_SQL}, k AS (SELECT *, q_label = label AS rel FROM r WHERE rank <= 10 AND score > 0),
q AS (SELECT qid, q_label, max(CAST(rel AS INTEGER)) AS hit, coalesce(1.0 / min(rank) FILTER (rel), 0) AS rr, avg(CAST(rel AS DOUBLE)) AS p FROM k GROUP BY 1, 2)
SELECT CAST(q_label AS VARCHAR) AS category, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(p), 6) AS precision FROM q GROUP BY ROLLUP (CAST(q_label AS VARCHAR))
""")
def dense_eval_hit_mrr_p(spark, sf_dir):
    top, docs, queries = _ranked(spark, sf_dir, 10)
    rows = top.join(docs.select("doc_id", "label"), "doc_id").join(queries.select("qid", "q_label"), "qid")
    scored = evaluation.by_query(rows, F.col("label") == F.col("q_label"), ["qid", "q_label"])
    return evaluation.macro(scored.withColumn("category", F.col("q_label").cast("string")))


@query(f"""
WITH {_RANKED_SQL}, p AS (SELECT * FROM r WHERE rank <= 50 AND score > 0),
f AS (SELECT *, max(label = 3 AND doc_id % 2 = 0) OVER (PARTITION BY qid) AS any_s, max(label = 3 OR doc_id % 17 = 0) OVER (PARTITION BY qid) AS any_l FROM p)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM f WHERE CASE WHEN any_s THEN label = 3 AND doc_id % 2 = 0 WHEN any_l THEN label = 3 OR doc_id % 17 = 0 ELSE true END
""")
def filter_ladder_fallback(spark, sf_dir):
    top, docs, _ = _ranked(spark, sf_dir, 50)
    pool = top.join(docs.select("doc_id", "label"), "doc_id")
    own, even, other = F.col("label") == 3, F.col("doc_id") % 2 == 0, F.col("doc_id") % 17 == 0
    return retrieval.filter_ladder(pool, own & even, own | other, by="qid").select("qid", "doc_id", "rank")


@query(f"""
WITH {_RANKED_SQL}, p AS (SELECT *, max(doc_id % 7 = 0) OVER (PARTITION BY qid) AS hit FROM r WHERE rank <= 200 AND score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM p WHERE doc_id % 7 = 0 OR NOT hit)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5
""")
def filter_pool_then_filter(spark, sf_dir):
    k = 5
    top, _, _ = _ranked(spark, sf_dir, retrieval.pool_size(k, attribute_filters=True, other_filters=False, with_feedback=False))
    wanted = F.col("doc_id") % 7 == 0
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return retrieval.filter_ladder(top, wanted, by="qid").withColumn("place", place).filter(F.col("place") <= k).select("qid", "doc_id", "rank", "place")


@query(f"""
WITH RECURSIVE {_RANKED_SQL}, pool AS (SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, ['c' || CAST(label % 4 AS VARCHAR), 'd' || CAST(doc_id % 3 AS VARCHAR)] AS classes FROM r WHERE rank <= 40 AND score > 0),
own AS (SELECT qid, rank, unnest(classes) AS class, unnest([1, 2]) AS place FROM pool),
cls AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY min(rank * 10 + place)) - 1 AS j, list(rank ORDER BY rank) AS ranks FROM own GROUP BY qid, class), n AS (SELECT qid, count(*) AS n FROM cls GROUP BY 1),
turn AS (
  SELECT qid, 0 AS step, CAST([] AS INTEGER[]) AS taken FROM n
  UNION ALL
  SELECT t.qid, t.step + 1, CASE WHEN len(taken) < 12 THEN list_concat(taken, list_slice(list_filter(ranks, lambda x: NOT list_contains(taken, x)), 1, 1)) ELSE taken END
  FROM turn t JOIN n ON n.qid = t.qid JOIN cls ON cls.qid = t.qid AND cls.j = t.step % n.n WHERE t.step < 12 * n.n
), done AS (SELECT t.qid, unnest(taken) AS rank FROM turn t JOIN n ON n.qid = t.qid WHERE t.step = 12 * n.n)
SELECT pool.* FROM pool JOIN done USING (qid, rank)
""")
def diversify_round_robin(spark, sf_dir):
    top, docs, _ = _ranked(spark, sf_dir, 40)
    classes = F.array(F.concat(F.lit("c"), (F.col("label") % 4).cast("string")), F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")))
    pool = top.join(docs.select("doc_id", classes.alias("classes")), "doc_id").select("qid", "doc_id", "rank", "classes")
    return retrieval.diversified(pool, 12)


@query("""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS INTEGER) AS place
FROM orders ORDER BY place LIMIT 50
""")
def tiered_sort_topn(spark, sf_dir):
    tier = [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_totalprice"), F.col("o_orderkey")]
    best = table(spark, sf_dir, "orders").orderBy(*tier).limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*tier))).select("o_orderkey", "place")


# Feedback: labels as votes, aged by their id.


def _votes(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    ts = F.lit(NOW).cast("timestamp") - F.make_dt_interval((F.col("doc_id") % 90).cast("int"))
    kind = F.when(F.col("toxic") == 1, "rating_down").when(F.col("quality") == 1, "rating_up").otherwise("correction")
    return rows.select(kind.alias("type"), ts.alias("ts"), F.array((F.col("doc_id") % 100).cast("string"), (F.col("doc_id") % 7).cast("string")).alias("ids"), "doc_id")


_VOTES_SQL = """
v AS (SELECT CASE WHEN toxic = 1 THEN -1.5 WHEN quality = 1 THEN 1.0 END * exp(-ln(2.0) * (doc_id % 90) / 30.0) AS w,
             unnest([CAST(doc_id % 100 AS VARCHAR), CAST(doc_id % 7 AS VARCHAR)]) AS doc_id FROM labels WHERE toxic = 1 OR quality = 1),
net AS (SELECT doc_id, sum(w) AS net FROM v GROUP BY 1)
"""


@query(f"WITH {_VOTES_SQL} SELECT doc_id, round(net, 6) AS net FROM net")
def feedback_decayed_scores(spark, sf_dir):
    return feedback.source_scores(_votes(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("doc_id", F.round("net", 6).alias("net"))


@query(f"""
WITH {_VOTES_SQL} SELECT CAST(p_partkey AS VARCHAR) AS doc_id, round(p_retailprice / 100000 + 0.05 * tanh(coalesce(net, 0)), 6) AS score
FROM part LEFT JOIN net ON net.doc_id = CAST(p_partkey AS VARCHAR)
""")
def feedback_rerank(spark, sf_dir):
    ranked = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), (F.col("p_retailprice") / 100000).alias("score"), F.col("p_partkey").alias("rank"))
    net = feedback.source_scores(_votes(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return feedback.reranked(ranked, net).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS total, count(*) FILTER (toxic = 0 AND quality = 1) AS up, count(*) FILTER (toxic = 1) AS down, count(*) FILTER (toxic = 0 AND quality = 0) AS corrections, count(*) FILTER (doc_id % 2 = 0) AS open FROM labels")
def feedback_stats(spark, sf_dir):
    return feedback.stats(_votes(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 2 == 0, "open").otherwise("resolved")))


@query("""
WITH e AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND length(text) >= 200),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM e) GROUP BY 1, 2),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf, sum(tf) AS cf FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT 4096),
d AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN v USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM d GROUP BY 1),
q AS (SELECT item_id AS qid, term, count(*) * any_value(idf) AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM benchmark) JOIN v USING (term) GROUP BY 1, 2),
qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM q GROUP BY 1),
s AS (SELECT qid, doc_id, round(sum(d.w / dn.norm * q.w / qn.norm), 6) AS score FROM q JOIN qn USING (qid) JOIN d USING (term) JOIN dn USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT qid, doc_id, score FROM r WHERE rank <= 2 AND score >= 0.15
""")
def fewshot_pick(spark, sf_dir):
    docs, good_ids = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    # ids go to the texts, which are neither shuffled nor sorted
    good = docs.join(F.broadcast(good_ids) if good_ids.count() <= retrieval.FEW_TERMS else good_ids, "doc_id").filter((F.length("text") >= 200) & (X.cleaned(F.col("text")) != ""))
    return feedback.nearest_examples(good, table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid"))


# Conversations.

_FOUND = {"disease": r"\bthe\b", "phase": r"\bder\b", "status": r"\bque\b"}


def _state(spark, sf_dir):
    low = F.lower("text")
    found = {n: F.when(low.rlike(p), F.substring(F.sha2("text", 256), 1, 8)) for n, p in _FOUND.items()}
    return conversation.carry_forward(table(spark, sf_dir, "conversations"), found, needed="disease")


_STATE_SQL = "u AS (SELECT conv_id, turn, " + ", ".join(
    f"last_value(CASE WHEN regexp_matches(lower(text), '{p}') THEN substr(sha256(text), 1, 8) END IGNORE NULLS) OVER w AS {n}0" for n, p in _FOUND.items()
) + """ FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT conv_id, turn, disease0 AS disease, CASE WHEN disease0 IS NOT NULL THEN phase0 END AS phase, CASE WHEN disease0 IS NOT NULL THEN status0 END AS status FROM u)"""


@query(f"WITH {_STATE_SQL} SELECT * FROM s")
def history_carry_forward(spark, sf_dir):
    return _state(spark, sf_dir)


@query(f"""WITH {_STATE_SQL} SELECT conv_id, turn, disease IS DISTINCT FROM lag(disease) OVER w OR phase IS DISTINCT FROM lag(phase) OVER w OR status IS DISTINCT FROM lag(status) OVER w AS changed
FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def history_changed_turns(spark, sf_dir):
    return conversation.changed_turns(_state(spark, sf_dir), list(_FOUND)).select("conv_id", "turn", "changed")


@query("""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Clinician' WHEN 'assistant' THEN 'Assistant' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1""")
def transcript(spark, sf_dir):
    return conversation.transcript(table(spark, sf_dir, "conversations"), {"user": "Clinician", "assistant": "Assistant"})


@query("SELECT conv_id, max_by(text, turn) FILTER (role = 'user' AND trim(text) <> '') AS text, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1")
def last_user_message(spark, sf_dir):
    return conversation.last_user_message(table(spark, sf_dir, "conversations"))


# Events: user and day stand for the session, value for latency, k of the properties for the number of sources.


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), "event_type", F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"), F.col("event_type").alias("endpoint"),
        F.concat(F.lit("q"), F.get_json_object("props", "$.k")).alias("query_text"), F.get_json_object("props", "$.k").try_cast("bigint").alias("num_sources"),
        F.col("value").alias("latency_ms"), F.when(F.col("value") > 60, "rating_up").when(F.col("value") > 20, "rating_down").otherwise("correction").alias("kind"),
    )


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


_EVENTS_SQL = f"""
n AS (SELECT TIMESTAMP '{NOW}' AS now),
e AS (SELECT ts, event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_type AS endpoint,
  'q' || json_extract_string(props, '$.k') AS query_text, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS num_sources, value AS latency_ms,
  CASE WHEN value > 60 THEN 'rating_up' WHEN value > 20 THEN 'rating_down' ELSE 'correction' END AS kind, now FROM events, n)
"""


@query("SELECT ts AS timestamp, event_type, CAST(user_id AS VARCHAR) AS user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS num_sources, CAST(NULL AS VARCHAR) AS kind FROM events WHERE event_type IS NOT NULL")
def events_typed_view(spark, sf_dir):
    payload = F.to_json(F.struct("event_type", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("num_sources")))
    log = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), payload.alias("text_payload"))
    return events.typed(log).select("timestamp", "event_type", "user_id", "num_sources", "kind")


@query(f"""WITH {_EVENTS_SQL} SELECT count(DISTINCT user_id) FILTER (ts >= now - INTERVAL 7 DAY) AS wau_this, count(DISTINCT user_id) FILTER (ts BETWEEN now - INTERVAL 14 DAY AND now - INTERVAL 7 DAY) AS wau_prev,
count(DISTINCT session_id) FILTER (ts >= now - INTERVAL 7 DAY) AS sessions_this, count(DISTINCT session_id) FILTER (ts BETWEEN now - INTERVAL 14 DAY AND now - INTERVAL 7 DAY) AS sessions_prev,
count(*) FILTER (event_type = 'view' AND ts >= now - INTERVAL 7 DAY) AS queries_this, count(*) FILTER (event_type = 'view' AND ts BETWEEN now - INTERVAL 14 DAY AND now - INTERVAL 7 DAY) AS queries_prev FROM e""")
def wau_wow(spark, sf_dir):
    return reports.headline(_events(spark, sf_dir), _now(), "view")


@query(f"""WITH {_EVENTS_SQL}, u AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_day, max(ts) AS last, any_value(now) AS now FROM e GROUP BY 1)
SELECT count(*) FILTER (first_day >= CAST(now AS DATE) - INTERVAL 7 DAY) AS new_users, count(*) FILTER (first_day < CAST(now AS DATE) - INTERVAL 7 DAY AND last >= now - INTERVAL 7 DAY AND user_id IS NOT NULL) AS returning_users FROM u""")
def new_vs_returning(spark, sf_dir):
    return reports.new_and_returning(_events(spark, sf_dir), _now())


_STEPS = {"searched": "view", "reached_chat": "click", "generated": "signup", "refined": "purchase", "failed": "error"}


@query(f"WITH {_EVENTS_SQL} SELECT " + ", ".join(f"count(DISTINCT session_id) FILTER (event_type = '{e}') AS {n}" for n, e in _STEPS.items()) + " FROM e WHERE ts >= now - INTERVAL 7 DAY")
def funnel(spark, sf_dir):
    return reports.funnel(_events(spark, sf_dir), _now(), _STEPS)


@query(f"""WITH {_EVENTS_SQL} SELECT count(*) FILTER (kind = 'rating_up') AS thumbs_up, count(*) FILTER (kind = 'rating_down') AS thumbs_down, count(*) FILTER (kind = 'correction') AS corrections,
round(count(*) FILTER (kind = 'rating_down') / nullif(count(*) FILTER (kind IN ('rating_up', 'rating_down')), 0), 6) AS down_rate FROM e WHERE event_type = 'click' AND ts >= now - INTERVAL 7 DAY""")
def quality_rate(spark, sf_dir):
    return reports.quality(_events(spark, sf_dir), _now(), "click").withColumn("down_rate", F.round("down_rate", 6))


@query(f"WITH {_EVENTS_SQL} SELECT query_text, count(*) AS thumbs_down_count FROM e WHERE event_type = 'click' AND kind = 'rating_down' AND query_text IS NOT NULL AND ts >= now - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_bad(spark, sf_dir):
    return reports.top_texts(_events(spark, sf_dir), _now(), (F.col("event_type") == "click") & (F.col("kind") == "rating_down"), "thumbs_down_count")


@query(f"WITH {_EVENTS_SQL} SELECT query_text, count(*) AS occurrences FROM e WHERE event_type = 'view' AND num_sources < 20 AND query_text IS NOT NULL AND ts >= now - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def zero_results(spark, sf_dir):
    return reports.top_texts(_events(spark, sf_dir), _now(), (F.col("event_type") == "view") & (F.col("num_sources") < 20), "occurrences")


@query(f"WITH {_EVENTS_SQL} SELECT endpoint, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, count(*) AS calls FROM e WHERE latency_ms IS NOT NULL AND ts >= now - INTERVAL 7 DAY GROUP BY 1")
def latency_quantiles(spark, sf_dir):
    return reports.latency(_events(spark, sf_dir), _now(), event=None)


@query(f"WITH {_EVENTS_SQL} SELECT session_id, max_by(user_id, ts) AS user_id, min(ts) AS started_at, max(ts) AS last_active_at, count(*) AS event_count, list_sort(list(DISTINCT event_type)) AS features_used FROM e GROUP BY 1")
def session_rollup(spark, sf_dir):
    return reports.sessions(_events(spark, sf_dir))


# Snapshots: documents as stored, and as they come in with changed, new and missing rows.


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return docs.filter("doc_id % 10 <> 1"), docs.filter("doc_id % 10 IN (1, 2, 3)").withColumn("text", changed)


_SNAPSHOT_SQL = """
old AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 10 <> 1),
new AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' (revised)' ELSE text END AS text, lang FROM documents WHERE doc_id % 10 IN (1, 2, 3))
"""


@query(f"WITH {_SNAPSHOT_SQL} SELECT doc_id, coalesce(new.lang, old.lang) AS lang, length(coalesce(new.text, old.text)) AS n_chars FROM old FULL JOIN new USING (doc_id)")
def merge_upsert(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return merge.upserted(old, new, "doc_id").select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"))


@query(f"""WITH {_SNAPSHOT_SQL} SELECT count(*) FILTER (old.doc_id IS NULL) AS n_new, count(*) FILTER (old.doc_id IS NOT NULL AND new.doc_id IS NOT NULL AND (old.text, old.lang) IS DISTINCT FROM (new.text, new.lang)) AS n_updated,
count(*) AS total FROM old FULL JOIN new USING (doc_id)""")
def merge_change_counts(spark, sf_dir):
    return merge.change_counts(merge.changes(*_snapshots(spark, sf_dir), "doc_id"))


@query(f"WITH {_SNAPSHOT_SQL} SELECT new.doc_id, substr(sha256(new.text), 1, 16) AS text_hash FROM new LEFT JOIN old USING (doc_id) WHERE old.text IS NULL OR old.text <> new.text")
def hash_delta(spark, sf_dir):
    old, new = (df.select("doc_id", merge.text_hash(F.col("text")).alias("text_hash")) for df in _snapshots(spark, sf_dir))
    return merge.hash_delta(new, old)


@query("SELECT d.doc_id, coalesce(e.embedding[1], 0.0::FLOAT) AS first, CAST(CASE WHEN e.vec_id IS NULL THEN 64 ELSE len(e.embedding) END AS INTEGER) AS dim FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_align(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return merge.aligned(table(spark, sf_dir, "documents").select("doc_id"), store, 64).select("doc_id", F.col("embedding")[0].alias("first"), F.size("embedding").alias("dim"))


# Versions: a customer's orders are the versions of one protocol.


def _versions(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("user_id"), F.col("o_custkey").alias("protocol_id"), F.row_number().over(w).alias("version"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("title"),
    )


_VERSIONS_SQL = """v AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS user_id, o_custkey AS protocol_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version,
o_orderdate AS ts, o_orderstatus AS phase, o_orderpriority AS title FROM orders)"""


@query(f"WITH {_VERSIONS_SQL} SELECT user_id, protocol_id, max(version) AS version, max_by(title, version) AS title, count(*) AS version_count FROM v GROUP BY 1, 2")
def versions_latest(spark, sf_dir):
    return versions.latest(_versions(spark, sf_dir), ["user_id", "protocol_id"]).select("user_id", "protocol_id", "version", "title", "version_count")


@query(f"WITH {_VERSIONS_SQL}, l AS (SELECT protocol_id, max(version) AS version, max_by(ts, version) AS ts FROM v WHERE user_id = '3' GROUP BY 1) SELECT * FROM l ORDER BY ts DESC, protocol_id LIMIT 100")
def versions_list(spark, sf_dir):
    return versions.listed(_versions(spark, sf_dir), "3").select("protocol_id", "version", "ts")


@query(f"""WITH {_VERSIONS_SQL}, p AS (SELECT protocol_id, lag(version) OVER w AS version_a, version AS version_b, lag(phase) OVER w AS pa, phase AS pb, lag(title) OVER w AS ta, title AS tb FROM v
WINDOW w AS (PARTITION BY protocol_id ORDER BY version))
SELECT protocol_id, version_a, version_b, 'phase' AS field, pa AS value_a, pb AS value_b FROM p WHERE version_a IS NOT NULL AND pa <> pb
UNION ALL SELECT protocol_id, version_a, version_b, 'title', ta, tb FROM p WHERE version_a IS NOT NULL AND ta <> tb""")
def version_diff(spark, sf_dir):
    return versions.diff(_versions(spark, sf_dir), ["protocol_id"], ["phase", "title"])


# Evaluation, reports and rendering beyond the above.


def _found_by_item(spark, sf_dir):
    """The documents found for each benchmark item, whole, with its five best-weighted terms as keywords; and those of all items."""
    index = retrieval.indexed(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = index.asked(table(spark, sf_dir, "benchmark"), "item_id", "text")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("w"), "term"))), 1, 5)
    told = asked.groupBy(F.col("doc_id").alias("item_id")).agg(F.transform(best, lambda x: x["term"]).alias("keywords"))
    words = staged(table(spark, sf_dir, "benchmark").select("item_id").join(told, "item_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))), "item-keywords")
    # what is found is few rows, which go to the texts
    top = staged(retrieval.pruned_top_k(asked, index, 5).withColumnRenamed("qid", "item_id"), "found")
    return top.join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id").join(words, "item_id"), words


_FOUND_SQL = f"""
{_WEIGHTS_SQL}, d AS (SELECT doc_id, term, w / norm AS w FROM raw JOIN nrm USING (doc_id)),
qtf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, {_TOKENS_SQL} AS term FROM benchmark) GROUP BY 1, 2),
qraw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN df USING (term)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qraw GROUP BY 1),
sc AS (SELECT item_id, doc_id, round(sum(d.w * qraw.w / qn.norm), 6) AS score FROM qraw JOIN qn USING (item_id) JOIN d USING (term) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc),
k AS (SELECT item_id, list_slice(list(term ORDER BY round(w / norm, 9) DESC, term), 1, 5) AS words FROM qraw JOIN qn USING (item_id) GROUP BY 1),
f AS (SELECT rk.item_id, rk.doc_id, rk.rank, lower(text) AS low, words, lang, source FROM rk JOIN documents USING (doc_id) JOIN k USING (item_id) WHERE rk.rank <= 5 AND rk.score > 0)
"""


@query(f"""
WITH {_FOUND_SQL}, s AS (SELECT doc_id, item_id, len(list_filter(words, lambda w: contains(low, w))) AS n, len(words) AS m FROM f)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_keywords, n >= greatest(1, m // 2) AS relevant FROM s
""")
def keyword_relevance(spark, sf_dir):
    return evaluation.keyword_relevance(_found_by_item(spark, sf_dir)[0], F.col("text")).select("doc_id", "item_id", "n_keywords", "relevant")


def _scored_items(spark, sf_dir, expected):
    found, words = _found_by_item(spark, sf_dir)
    meta = F.to_json(F.struct("lang", "source"))
    scored = evaluation.judged_by_query(found.withColumn("expected_ids", expected), ["item_id"], F.col("text"), meta)
    every = words.select("item_id").join(scored, "item_id", "left").fillna(0, ["hit", "rr", "precision"])
    return every.withColumn("category", F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")))


def _judged(spark, sf_dir, expected):
    return evaluation.macro(_scored_items(spark, sf_dir, expected))


_JUDGED_SQL = """
g AS (SELECT item_id, rank, doc_id, list_filter(list_distinct(words), lambda w: contains(low || chr(10) || '{"lang":"' || lang || '","source":"' || source || '"}', w)) AS hits, len(words) AS m FROM f),
h AS (SELECT item_id, max(m) AS m, count(*) AS n, len(list_distinct(flatten(list(hits)))) AS kw, min(rank) FILTER (len(hits) > 0) AS first_kw, count(*) FILTER (len(hits) > 0) AS with_kw FROM g GROUP BY 1)
"""
_MACRO_SQL = "SELECT category, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(precision), 6) AS precision FROM a GROUP BY ROLLUP (category)"


@query(f"""
WITH {_FOUND_SQL}, {_JUDGED_SQL}, a AS (SELECT 'c' || CAST(b.item_id % 4 AS VARCHAR) AS category, CASE WHEN coalesce(kw, 0) >= greatest(1, coalesce(m, 0) // 2) THEN 1 ELSE 0 END AS hit,
  coalesce(1.0 / first_kw, 0) AS rr, coalesce(with_kw * 1.0 / h.n, 0) AS precision FROM benchmark b LEFT JOIN h USING (item_id)) {_MACRO_SQL}
""")
def keyword_eval_hit_mrr_p(spark, sf_dir):
    """Items have keywords alone."""
    return _judged(spark, sf_dir, F.array().cast("array<bigint>"))


@query(f"""
WITH {_FOUND_SQL}, {_JUDGED_SQL}, i AS (SELECT item_id, min(rank) FILTER (doc_id % 3 = 0) AS first_id FROM g GROUP BY 1),
a AS (SELECT 'c' || CAST(b.item_id % 4 AS VARCHAR) AS category, CASE WHEN first_id IS NOT NULL THEN 1 ELSE 0 END AS hit, coalesce(1.0 / first_id, 1.0 / first_kw, 0) AS rr,
  coalesce(with_kw * 1.0 / h.n, 0) AS precision FROM benchmark b LEFT JOIN h USING (item_id) LEFT JOIN i USING (item_id)) {_MACRO_SQL}
""")
def judged_eval_hit_mrr_p(spark, sf_dir):
    """Items have keywords and expected ids: here the multiples of three among what is found, and one that is not."""
    return _judged(spark, sf_dir, F.array(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(F.lit(-1)), F.lit(-1).cast("bigint")))


@query("""
SELECT round(avg(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 5 + 1 END), 6) AS faithfulness, round(avg(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 3 + 1 END), 6) AS relevance,
  round(avg(0), 6) AS completeness, round(avg(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE (doc_id % 5 + doc_id % 3 + 2) / 3.0 END), 6) AS overall FROM labels
""")
def judge_means(spark, sf_dir):
    k = F.col("doc_id")
    verdict = F.when(k % 11 == 0, "no verdict").otherwise(F.format_string('{"faithfulness": %d, "relevance": %d}', k % 5 + 1, k % 3 + 1))
    return evaluation.judged(table(spark, sf_dir, "labels").select(verdict.alias("verdict")))


@query("SELECT count(*) AS n, bit_xor(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || ':' || text), 1, 15) AS BIGINT)) AS digest FROM documents")
def corpus_fingerprint(spark, sf_dir):
    head = F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")), 256), 1, 15)
    return fingerprint(table(spark, sf_dir, "documents"), F.conv(head, 16, 10).cast("bigint"))


@query(f"""
WITH {_EVENTS_SQL}, w AS (SELECT event_type, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS this, count(*) FILTER (ts < now - INTERVAL 7 DAY AND ts >= now - INTERVAL 14 DAY) AS prev FROM e GROUP BY 1)
SELECT event_type, CASE WHEN this = 0 AND prev = 0 THEN '—' WHEN prev = 0 THEN '(new)' ELSE (CASE WHEN this >= prev THEN '+' ELSE '−' END) || printf('%.1f%%', abs(this - prev) * 100.0 / prev) END AS change,
  CASE WHEN this > prev THEN 'up' WHEN this < prev THEN 'down' ELSE 'flat' END AS direction FROM w
""")
def week_changes(spark, sf_dir):
    ts, now = F.col("timestamp"), _now()
    week, two = now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 14 DAYS")
    counts = _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(ts >= week).alias("this"), F.count_if((ts < week) & (ts >= two)).alias("prev"))
    return counts.select("event_type", X.week_change(F.col("this"), F.col("prev")).alias("change"), X.change_class(F.col("this"), F.col("prev")).alias("direction"))


@query("""
SELECT o_orderkey, concat_ws(' — ', CASE o_orderstatus WHEN 'P' THEN 'RWE' WHEN 'O' THEN 'Phase II' END, CASE WHEN o_orderkey % 3 = 0 THEN 'TNBC' END,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Drug ' || CAST(o_orderkey % 7 AS VARCHAR) END) AS built,
  CASE WHEN concat_ws('', CASE WHEN o_orderstatus IN ('P', 'O') THEN 'x' END, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'x' END) = '' THEN 'Untitled protocol' END AS fallback FROM orders
""")
def protocol_titles(spark, sf_dir):
    k = F.col("o_orderkey")
    phase = F.when(F.col("o_orderstatus") == "P", "N/A").when(F.col("o_orderstatus") == "O", "Phase II")
    title = X.protocol_title(phase, F.when(k % 3 == 0, "Triple-negative disease"), F.when(k % 2 == 0, F.concat(F.lit("Drug "), (k % 7).cast("string"), F.lit(" (also known)"))), F.lit(None).cast("string"))
    untitled = title == "Untitled protocol"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(untitled, "").otherwise(title).alias("built"), F.when(untitled, title).alias("fallback"))


@query(f"""
WITH {_VERSIONS_SQL} SELECT protocol_id, version, CASE WHEN version > 1 AND version % 2 = 0 THEN 'change ' || CAST(version AS VARCHAR) ELSE '' END AS user_request FROM v
""")
def versions_with_notes(spark, sf_dir):
    store = _versions(spark, sf_dir).select("protocol_id", "version")
    log = store.filter("version > 1 AND version % 2 = 0").select("protocol_id", "version", F.concat(F.lit("change "), F.col("version").cast("string")).alias("user_request"), F.lit("ok").alias("assistant_note"))
    return versions.with_notes(store, log, ["protocol_id"]).select("protocol_id", "version", "user_request")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS label FROM orders")
def display_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.label_of(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("label"))


@query("SELECT c_custkey, '{\"k\": ' || CAST(c_custkey AS VARCHAR) || '}' AS body, ['name', 'size'] AS changed, 'note ' || CAST(c_custkey AS VARCHAR) AS note FROM customer")
def refined_replies(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit('```json\n{"k": '), k, F.lit("}\nCHANGES: name, size,\nNOTE: note "), k, F.lit("\n```"))
    body, changed, note = X.refined_reply(F.col("raw"))
    return table(spark, sf_dir, "customer").withColumn("raw", raw).select("c_custkey", body.alias("body"), changed.alias("changed"), note.alias("note"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started_at, count(*) AS event_count FROM s GROUP BY user_id, n
""")
def session_windows(spark, sf_dir):
    rows = streams.session_windows(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "event_count")


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS corpus, count(*) AS trial_count FROM documents GROUP BY ROLLUP (lang)")
def ingest_summary(spark, sf_dir):
    return totals(table(spark, sf_dir, "documents"), "lang")
