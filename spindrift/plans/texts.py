"""Registered queries that render, parse and label texts of the given tables, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import conversation, documents, evaluation, feedback, landscape, variants, versions
from ..operators.dictionary import expanded
from ..operators.store import BucketStore
from ..sources import trials
from ..sources.files import shared_folder
from .catalog import NOW, query, table


def _replies(spark, sf_dir):
    c, t = table(spark, sf_dir, "conversations"), F.col("turn").cast("string")
    offered = F.concat("text", F.lit("\n[CHOICES]\n- "), "role", F.lit("\n- turn "), t, F.lit("\nand so on\n[/CHOICES]"))
    applied = F.concat(F.lit("[APPLY_PROTOCOL_CHANGES] apply: "), t, F.lit(", 9 [/APPLY_PROTOCOL_CHANGES] "), "text")
    return c.withColumn("offered", offered).withColumn("told", F.when(F.col("turn") % 2 == 0, applied).otherwise(F.col("text")))


@query(r"""
WITH c AS (SELECT conv_id, turn, role, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS clean FROM conversations)
SELECT conv_id, turn, substr(sha256(clean), 1, 16) AS shown_hash, [role, 'turn ' || CAST(turn AS VARCHAR)] AS choices, substr(sha256(clean), 1, 16) AS rest_hash, CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) || ', 9' END AS applied,
  length(text) + length('&lt;b&gt;&amp;&#39;&quot;') AS escaped_length, false AS confirmed, true AS agreed FROM c
""")
def conversation_replies(spark, sf_dir):
    """Messages with a block of choices and a directive: what is shown, offered and applied, and their text as markup."""
    rows = _replies(spark, sf_dir)
    (shown, offered), (rest, applied) = X.choices(F.col("offered")), X.apply_directive(F.col("told"))
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    escaped = X.markup_escaped(F.concat("text", F.lit("<b>&'\"")))
    return rows.select(
        "conv_id", "turn", short(shown).alias("shown_hash"), offered.alias("choices"), short(rest).alias("rest_hash"), applied.alias("applied"), F.char_length(escaped).cast("long").alias("escaped_length"),
        X.confirms(F.col("text")).alias("confirmed"), X.confirms(F.concat(F.lit("Yes, please apply "), F.col("turn").cast("string"), F.lit(" and 3!"))).alias("agreed"),
    )


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, ts, floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 60) AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(CAST(m AS BIGINT) AS VARCHAR) || 'm ago' WHEN m < 1440 THEN CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR) || 'h ago'
  WHEN m < 43200 THEN CAST(CAST(floor(m / 1440) AS BIGINT) AS VARCHAR) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS age, CASE WHEN user_id % 7 = 0 THEN 'anonymous' ELSE CAST(user_id AS VARCHAR) || '_' || event_type || '_x' END AS user_key,
  'v' || CAST(user_id % 3 + 1 AS VARCHAR) || CASE WHEN user_id % 3 = 0 THEN ' (original)' ELSE '' END AS label, CASE WHEN user_id % 2 = 0 THEN 'protocol' ELSE event_type END AS file FROM e
""")
def event_labels(spark, sf_dir):
    """Ages, user keys, version labels and file names of all events."""
    k, kind = F.col("user_id"), F.col("event_type")
    user = F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit("/"), kind, F.lit(" x ")))
    age = X.age_text(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", age.alias("age"), X.user_key(user).alias("user_key"), X.version_label(k % 3 + 1).alias("label"), X.file_name(F.when(k % 2 == 0, " ").otherwise(kind)).alias("file"))


#: Said in front of each turn's text, by its number.
_SAID = ["", "TNBC, ", "phase 3, recruiting: ", "HER2-low "]


@query("""
WITH u AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'Triple-Negative Breast Cancer (TNBC)' WHEN 3 THEN 'HER2-Low Breast Cancer' END AS d, CASE turn % 4 WHEN 2 THEN 'PHASE3' END AS p, CASE turn % 4 WHEN 2 THEN 'RECRUITING' END AS s FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, last_value(d IGNORE NULLS) OVER w AS disease, last_value(p IGNORE NULLS) OVER w AS p, last_value(s IGNORE NULLS) OVER w AS s FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
f AS (SELECT conv_id, turn, disease, CASE WHEN disease IS NOT NULL THEN p END AS phase, CASE WHEN disease IS NOT NULL THEN s END AS status FROM c)
SELECT *, (disease, phase, status) IS DISTINCT FROM (lag(disease) OVER w, lag(phase) OVER w, lag(status) OVER w) AS changed FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def turn_filters(spark, sf_dir):
    """Population, phase and status that conversations have named so far, and the turns that change them."""
    k = F.col("turn")
    said = F.element_at(F.array(*map(F.lit, _SAID)), (k % 4 + 1).cast("int"))
    found = landscape.merged_filters(table(spark, sf_dir, "conversations").withColumn("text", F.concat(said, "text")))
    return conversation.changed_turns(found, ["disease", "phase", "status"])


@query("""
WITH d AS (SELECT doc_id // 3 AS k, n_chars, lang, row_number() OVER () AS pos FROM documents), l AS (SELECT k, max_by(n_chars, pos) AS n_chars, max_by(lang, pos) AS lang FROM d GROUP BY k)
SELECT 'K' || CAST(k AS VARCHAR) AS "nctId", n_chars, lang FROM l WHERE k % 5 <> 0
""")
def latest_snapshot(spark, sf_dir):
    """The last row read of each key; rows without a key go."""
    from ..sources import order

    k = F.floor(F.col("doc_id") / 3)
    rows = order.read(spark, f"{sf_dir}/documents.parquet").select(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("K"), k.cast("string"))).alias("nctId"), "n_chars", "lang", "pos")
    return trials.latest_by_key(rows.repartition(5, "lang")).drop("pos")


@query("""
WITH p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.conv_id % 3 <> 0),
t AS (SELECT conv_id, turn, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS query, regexp_replace(a, '^\\s+|\\s+$', '', 'g') AS answer FROM p)
SELECT query, CASE WHEN length(answer) > 1200 THEN regexp_replace(substr(answer, 1, 1200), ' +$', '') || '…' ELSE answer END AS answer FROM t WHERE query <> '' AND length(answer) >= 200
""")
def feedback_examples(spark, sf_dir):
    """Answers that may serve as examples: turns of two conversations in three count as upvoted."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    pairs = asked.join(c.filter("role = 'assistant'"), ["conv_id", "turn"])
    kind = F.when(F.col("conv_id") % 3 == 0, "rating_down").otherwise("rating_up")
    return feedback.examples(pairs.select(kind.alias("type"), F.struct("query", F.col("text").alias("assistant_message")).alias("context")))


@query("""
WITH a AS (SELECT lower(p_name) AS alias, p_brand AS canonical, p_partkey FROM part), l AS (SELECT alias, max_by(canonical, p_partkey) AS canonical FROM a WHERE p_partkey % 4 = 0 GROUP BY 1), o AS (SELECT DISTINCT alias, 'old' AS canonical FROM a WHERE p_partkey % 4 = 1)
SELECT coalesce(l.alias, o.alias) AS alias, coalesce(l.canonical, o.canonical) AS canonical FROM l FULL JOIN o ON l.alias = o.alias
""")
def alias_upserts(spark, sf_dir):
    """A stored alias dictionary and many new entries, the last of each alias counting."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 4 = 1").select(F.lower("p_name").alias("alias"), F.lit("old").alias("canonical")).distinct()
    new = part.filter("p_partkey % 4 = 0").select(F.concat(F.lit(" "), F.initcap("p_name")).alias("alias"), "p_brand", F.col("p_partkey").alias("pos"))
    return feedback.upserted_aliases(old, new.select("alias", F.concat("p_brand", F.lit(" ")).alias("canonical"), "pos"))


def _dictionary(spark, sf_dir):
    """alias, canonical: two words of each document's text, from all over the table, as names of it."""
    d = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    own = d.select("doc_id", words.alias("w")).filter(F.size("w") >= 8)
    pairs = own.select("doc_id", F.explode(F.array(*[F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1]) for i in (0, 3)], F.concat_ws(" ", F.col("w")[0], F.col("w")[1], F.col("w")[2]))).alias("alias"))
    return pairs.groupBy("alias").agg(F.min("doc_id").alias("d")).select("alias", F.concat(F.lit("name"), F.col("d").cast("string")).alias("canonical"))


_WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
al AS (SELECT alias, min(doc_id) AS d, len(string_split(alias, ' ')) AS n FROM (SELECT doc_id, unnest([w[1] || ' ' || w[2], w[4] || ' ' || w[5], w[1] || ' ' || w[2] || ' ' || w[3]]) AS alias FROM w WHERE len(w) >= 8) GROUP BY alias),
q AS (SELECT item_id AS id, {_WORDS_SQL} AS w FROM benchmark),
g AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM q, range(1, 2000) r(i), (VALUES (2), (3)) s(n) WHERE i + n - 1 <= len(w)),
h AS (SELECT id, i, g.n AS n, alias, 'name' || CAST(d AS VARCHAR) AS canonical, row_number() OVER (PARTITION BY id ORDER BY g.n DESC, length(alias) DESC, i) AS k FROM g JOIN al ON al.alias = g.gram AND al.n = g.n),
z AS (SELECT id, max(k) AS m FROM h GROUP BY 1),
pick AS (SELECT id, 0::BIGINT AS k, []::BIGINT[] AS used, []::VARCHAR[] AS names FROM z
  UNION ALL SELECT p.id, h.k, CASE WHEN list_has_any(used, range(h.i, h.i + h.n)) THEN used ELSE list_concat(used, range(h.i, h.i + h.n)) END, CASE WHEN list_has_any(used, range(h.i, h.i + h.n)) THEN names ELSE list_append(names, canonical) END FROM pick p JOIN h ON h.id = p.id AND h.k = p.k + 1)
SELECT p.id AS qid, list_sort(list_distinct(names)) AS names FROM pick p JOIN z ON z.id = p.id AND z.m = p.k
""")
def dictionary_names(spark, sf_dir):
    """The names of a large alias dictionary that the benchmark's texts hold, longest first, a word counting once."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return expanded(items, "qid", "text", _dictionary(spark, sf_dir)).filter(F.size("names") > 0).select("qid", "names")


@query(r"""
WITH q AS (SELECT item_id % 20 AS user_id, max_by(text, item_id) AS text FROM benchmark GROUP BY 1),
t AS (SELECT doc_id % 20 AS user_id, doc_id, 0 AS own, text FROM documents UNION ALL SELECT user_id, NULL, 1, text FROM q),
tf AS (SELECT user_id, doc_id, own, term, count(*) AS tf FROM (SELECT user_id, doc_id, own, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM t) GROUP BY ALL),
n AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1), v AS (SELECT user_id, term, count(*) AS df, sum(tf) AS cf, row_number() OVER (PARTITION BY user_id ORDER BY sum(tf) DESC, term) AS r FROM tf GROUP BY 1, 2),
i AS (SELECT user_id, term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM v JOIN n USING (user_id) WHERE r <= 2048), w AS (SELECT tf.*, (1 + ln(tf)) * idf AS w FROM tf JOIN i USING (user_id, term)),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY user_id, doc_id, own)) AS u FROM w),
s AS (SELECT a.user_id, a.doc_id, round(sum(a.u * b.u), 6) AS score FROM u a JOIN u b USING (user_id, term) WHERE a.own = 0 AND b.own = 1 GROUP BY 1, 2),
f AS (SELECT d.doc_id % 20 AS user_id, d.doc_id, coalesce(score, 0) AS score FROM documents d JOIN q ON q.user_id = d.doc_id % 20 LEFT JOIN s ON s.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id DESC) AS place FROM f)
SELECT CAST(user_id AS VARCHAR) AS user_id, doc_id AS protocol_id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10
""")
def user_matches(spark, sf_dir):
    """Every user's query against the user's own entries, weights fitted by user, in one plan."""
    user = lambda c: (F.col(c) % 20).cast("string").alias("user_id")
    entries = table(spark, sf_dir, "documents").select(user("doc_id"), F.col("doc_id").alias("protocol_id"), F.col("doc_id").alias("ts"), "text")
    asked = table(spark, sf_dir, "benchmark").groupBy(user("item_id")).agg(F.max_by("text", "item_id").alias("query"))
    return versions.matched(entries, asked, ["text"]).select("user_id", "protocol_id", "score", "place")


@query(r"""
WITH c AS (SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user' AND trim(text) <> ''), '') AS query, coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS assistant_message FROM conversations GROUP BY 1)
SELECT conv_id, query, assistant_message, list_transform(range(1, least(conv_id % 30, 25) + 1), lambda i: 'NCT' || CAST(i AS VARCHAR)) AS source_nct_ids FROM c
""")
def feedback_contexts(spark, sf_dir):
    """What a vote on each conversation's last answer is stored with; of the ids shown every second is blank."""
    c = table(spark, sf_dir, "conversations")
    ids = F.flatten(F.transform(F.sequence(F.lit(1), F.col("conv_id") % 30), lambda i: F.array(F.lit(" "), F.concat(F.lit(" NCT"), i.cast("string")))))
    sources = c.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 30 > 0, ids).alias("ids"))
    return documents.feedback_context(c, sources)


@query("""
SELECT o_orderkey, 'F: ' || o_orderstatus || chr(10) || 'P: ' || o_orderpriority AS of_struct, '• ' || o_orderstatus || chr(10) || '• x' AS of_list, CAST(o_custkey AS VARCHAR) AS of_number, o_orderpriority AS of_text, '' AS of_null FROM orders
""")
def protocol_fields(spark, sf_dir):
    """Fields of any shape as they are displayed."""
    body = F.struct(
        F.struct(F.col("o_orderstatus").alias("F"), F.concat("o_orderpriority", F.lit(" ")).alias("P"), F.lit(" ").alias("Q")).alias("of_struct"), F.array("o_orderstatus", F.lit(" "), F.lit(" x ")).alias("of_list"),
        F.col("o_custkey").alias("of_number"), F.col("o_orderpriority").alias("of_text"), F.lit(None).cast("string").alias("of_null"),
    )
    v = F.parse_json(F.to_json(body, {"ignoreNullFields": "false"}))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    names = ["of_struct", "of_list", "of_number", "of_text", "of_null"]
    return rows.select("o_orderkey", *[variants.field_text(F.try_variant_get("v", f"$.{n}", "variant")).alias(n) for n in names])


@query("SELECT c_custkey, 1 AS version, c_mktsegment AS title, '' AS user_request, 'Initial version' AS assistant_note, true AS has_id FROM customer")
def first_versions(spark, sf_dir):
    """A new protocol for every customer, saved and read again."""
    from .engine import ProtocolStore

    schema = "user_id string, protocol_id string, version int, ts string, title string, c_custkey bigint, user_request string, assistant_note string"
    store = ProtocolStore(spark, shared_folder(spark, f"protocols-{uuid.uuid4().hex}"), schema)
    made = store.create(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).cast("string").alias("user_id"), F.col("c_mktsegment").alias("title"), "c_custkey"), NOW)
    read = store.read().join(made.select("protocol_id"), "protocol_id", "left_semi")
    return read.select("c_custkey", "version", "title", "user_request", "assistant_note", (F.length("protocol_id") == 36).alias("has_id"))


@query("""
WITH i AS (SELECT doc_id // 2 * 2 AS k, max_by(lang || ' new', doc_id) AS lang, max_by(n_chars, doc_id) AS n FROM documents WHERE doc_id % 10 >= 6 GROUP BY 1), o AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 <> 0)
SELECT count(*) FILTER (o.doc_id IS NULL) AS n_new, count(*) FILTER (o.doc_id IS NOT NULL AND i.k IS NOT NULL) AS n_updated, count(*) AS total, CAST(sum(coalesce(i.n, o.n_chars)) AS BIGINT) AS chars, count(*) FILTER (coalesce(i.lang, o.lang) LIKE '% new') AS renewed FROM o FULL JOIN i ON i.k = o.doc_id
""")
def ingested_snapshot(spark, sf_dir):
    """A stored snapshot after an incremental update whose rows repeat: counts, and the table that was written."""
    from .engine import Engine

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    store = BucketStore(spark, shared_folder(spark, f"snapshot-{uuid.uuid4().hex}"), "doc_id", 32)
    store.create(docs.filter("doc_id % 3 <> 0"))
    incoming = docs.filter("doc_id % 10 >= 6").select((F.floor(F.col("doc_id") / 2) * 2).alias("doc_id"), F.concat("lang", F.lit(" new")).alias("lang"), "n_chars", F.col("doc_id").alias("pos"))
    counts = Engine.ingest(store, incoming)
    written = store.read().agg(F.sum("n_chars").alias("chars"), F.count_if(F.col("lang").endswith(" new")).alias("renewed"))
    return written.select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()], "chars", "renewed")


@query()
def evaluation_report(spark, sf_dir):
    """The evaluation of all items as one nested report; its figures are those of keyword_eval_hit_mrr_p, so tests compare with them."""
    from .catalog import _scored_items

    return evaluation.report_json(_scored_items(spark, sf_dir, F.array().cast("array<bigint>")))
