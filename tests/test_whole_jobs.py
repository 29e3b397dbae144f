"""Registered queries over whole tables: no rows of theirs are left out."""

import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from comparing import of_sql, rows

from spindrift.operators import evaluation, retrieval
from spindrift.plans import catalog
from spindrift.sources.files import staged

SF01 = "/root/testdata/sf0.01"


def test_rerank_of_every_part(spark):
    want = of_sql(
        f"WITH {catalog._VOTES_SQL} SELECT CAST(p_partkey AS VARCHAR) AS doc_id, round(p_retailprice / 100000 + 0.05 * tanh(coalesce(net, 0)), 6) AS score "
        "FROM part LEFT JOIN net ON net.doc_id = CAST(p_partkey AS VARCHAR)", SF01,
    )
    assert len(want) > 200
    assert rows(catalog.feedback_rerank(spark, SF01).toPandas()) == rows(want)


@pytest.fixture
def searched(spark, tmp_path):
    """45 items, each with a word of its own that one document holds; the last item finds nothing."""
    items = [(i, f"word{i} common other{i}") for i in range(44)] + [(44, "nowhere")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1000 + i, f"Word{i} and OTHER{i}", "en", "web") for i in range(44)] + [(2000, "common", "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_every_item_is_judged_on_what_it_finds(spark, searched):
    got = {(r["item_id"], r["doc_id"]): (r["n_keywords"], r["relevant"]) for r in catalog.keyword_relevance(spark, searched).collect()}
    assert got == {(i, 1000 + i): (2, True) for i in range(44)} | {(i, 2000): (1, True) for i in range(44)}
    total = next(r for r in catalog.keyword_eval_hit_mrr_p(spark, searched).collect() if r["category"] is None)
    assert (total["n"], total["hit_rate"], total["mrr"]) == (45, round(44 / 45, 6), round(44 / 45, 6))


def test_judged_pairs_are_the_search_results(spark):
    got = {(r["item_id"], r["doc_id"]) for r in catalog.keyword_relevance(spark, SF01).collect()}
    found = {(q, d) for q, d in of_sql(catalog.ORACLES["tfidf_topk_benchmark"], SF01)[["qid", "doc_id"]].itertuples(index=False)}
    assert got == found


def test_keywords_of_a_query_count_over_its_results(spark):
    words = ["a1", "b1", "c1", "d1"]
    rows = [(1, 1, "none", words, 10, []), (1, 2, "A1", words, 11, []), (1, 3, "b1 x", words, 12, []), (2, 1, "x", ["a1"], 10, []), (3, 1, "A1 b1", words, 10, [12]), (3, 2, "none", words, 12, [12])]
    made = spark.createDataFrame(rows, "q long, rank int, text string, keywords array<string>, doc_id long, expected_ids array<long>")
    got = evaluation.judged_by_query(made, ["q"], catalog.F.col("text"))
    # two of four keywords in different rows are a hit; expected ids come before keywords
    assert {r["q"]: (r["hit"], r["rr"], round(r["precision"], 6)) for r in got.collect()} == {1: (1, 0.5, 0.666667), 2: (0, 0.0, 0.0), 3: (1, 0.5, 0.5)}


def test_pool_reaches_rank_200(spark, tmp_path):
    """Vectors turn away from query 0 by their place; multiples of 7, which match, stand at ranks 150 and 160 only."""
    others = [i for i in range(1, 400) if i % 7 and i % 50][:230]
    order = [0, *others[:149], 7, *others[149:158], 14, *others[158:]]
    data = [(i, [math.cos(n / 200), math.sin(n / 200)], 0) for n, i in enumerate(order)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [(r["doc_id"], r["rank"], r["place"]) for r in catalog.filter_pool_then_filter(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(7, 150, 1), (14, 160, 2)]


def brute_picks(examples, asked):
    """(query, example, score): the two nearest by cosine of tf * idf over the 4,096 most frequent words, from 0.15 on."""
    words = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    counts = {d: Counter(words(t)) for d, t in examples}
    cf, df = Counter(), Counter()
    for c in counts.values():
        cf.update(c)
        df.update(c.keys())
    kept = sorted(cf, key=lambda t: (-cf[t], t))[:4096]
    idf = {t: math.log((1 + len(counts)) / (1 + df[t])) + 1 for t in kept}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    own, out = {d: unit(c) for d, c in counts.items()}, []
    for q, text in asked:
        w = unit(Counter(words(text)))
        best = sorted((-round(sum(x * own[d].get(t, 0.0) for t, x in w.items()), 6), d) for d in own)[:2]
        out += [(q, d, -s) for s, d in best if -s >= 0.15]
    return sorted(out)


def test_examples_match_on_late_words(spark, tmp_path):
    docs = [(1, "filler " * 40 + "palbociclib"), (2, "other words " * 30), (3, "palbociclib " + "bad " * 60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    asked = [(5, "palbociclib filler"), (6, "unknown")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in catalog.fewshot_pick(spark, str(tmp_path)).collect())
    assert got == brute_picks(docs[:2], asked) and [r[:2] for r in got] == [(5, 1)]


def test_examples_equal_brute_force(spark):
    of = lambda sql: [tuple(r) for r in of_sql(sql, SF01).itertuples(index=False)]
    examples = of("SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND length(text) >= 200")
    want = brute_picks(examples, of("SELECT item_id, text FROM benchmark"))
    got = sorted(tuple(r) for r in catalog.fewshot_pick(spark, SF01).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_words_of_entries_are_not_shuffled_to_match_them(spark):
    """A match is that of plain Python, also with entries that repeat or are empty; before, every word was shuffled by entry."""
    import math
    import re
    from collections import Counter

    from spindrift.operators import versions

    rows = [(f"u{i % 3}", i // 2 if i % 3 == 1 else i, i, f"word{i % 7} word{i % 5} both both of{i}" if i % 11 else None) for i in range(60)]
    said = {"u0": "word1 both of3", "u1": "word2 word3 both"}
    asked = spark.createDataFrame(list(said.items()), "user_id string, query string")
    found = versions.matched(spark.createDataFrame(rows, "user_id string, protocol_id long, ts long, t string"), asked, ["t"], most=6, vocabulary=15)
    want = set()
    words = lambda t: Counter(re.findall(r"\w{2,}", (t or "").lower()))
    for user, query in said.items():
        texts = {}
        for u, p, _, t in rows:
            if u == user:
                texts[p] = texts.get(p, Counter()) + words(t)
        n = 1 + sum(u == user for u, *_ in rows)
        every = [*texts.values(), words(query)]
        cf, df = sum(every, Counter()), Counter(w for x in every for w in x)
        idf = {w: math.log((1 + n) / (df[w] + 1)) + 1 for w in sorted(cf, key=lambda w: (-cf[w], w))[:15]}
        unit = lambda x: (lambda v: {w: y / math.sqrt(sum(z * z for z in v.values())) for w, y in v.items()})({w: (math.log(c) + 1) * idf[w] for w, c in x.items() if w in idf})  # noqa: E731, B023
        q = unit(words(query))
        scores = {p: round(sum(y * q.get(w, 0) for w, y in unit(x).items()), 6) for p, x in texts.items()}
        ranked = sorted(((-scores[p], -ts, p) for u, p, ts, _ in rows if u == user))[:6]
        want |= {(user, p, -s + 0.0, i + 1) for i, (s, _, p) in enumerate(ranked)}
    assert {(r["user_id"], r["protocol_id"], round(r["score"], 6) + 0.0, r["place"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*protocol_id[^)]*term", plan)


def test_texts_stay_where_they_are_when_documents_are_found(spark, sf_dir):
    """What is found goes to the documents; before, all texts were shuffled to meet a few rows."""
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        plan = catalog._found_by_item(spark, sf_dir)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "hashpartitioning(doc_id" not in plan


@pytest.mark.parametrize("few", [1_000_000, 0])
@pytest.mark.parametrize("parts", [9, 1])
def test_texts_are_counted_where_they_are(spark, tmp_path, monkeypatch, parts, few):
    """Rows of one id (also of none) are one document, and texts of a table in several parts aren't shuffled; before, all were, by id."""
    docs = [(i if i < 40 else i % 6 or None, f"Word{i % 5} word{i % 7} both, both of{i}" if i % 11 else ["", None][i % 2]) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    plans = []

    def noted(df, label):
        if label == "term-counts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(retrieval, "staged", noted)
    monkeypatch.setattr(catalog, "staged", noted)
    monkeypatch.setattr(retrieval, "FEW_TERMS", few)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # a part for each file
    try:
        got = catalog.tfidf_doc_norms(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    documents = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841  the SQL reads it
    own = lambda frame: rows(frame.astype({"doc_id": "Int64"}))
    assert own(got) == own(duckdb.sql(catalog.ORACLES["tfidf_doc_norms"]).df())
    assert ("Exchange" in plans[0]) == (parts == 1)


def test_texts_of_examples_are_not_sorted(spark, tmp_path, monkeypatch):
    """The labelled ids go to the texts and words are counted there; before, a task sorted its share of all texts to join them, and its documents' words again."""
    spark.read.parquet(f"{SF01}/documents.parquet").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF01}/{t}.parquet")
    plans = []
    monkeypatch.setattr(retrieval, "staged", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or staged(df, label))
    told = {"spark.sql.files.maxPartitionBytes": "1m", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    try:
        got = catalog.fewshot_pick(spark, str(tmp_path)).toPandas()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert rows(got) == rows(catalog.fewshot_pick(spark, SF01).toPandas())
    plan = next(p for label, p in plans if label == "term-counts")
    assert "hashpartitioning" not in plan and "Sort" not in plan and "ObjectHashAggregate" not in plan
