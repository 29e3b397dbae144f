import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.operators import conversation, documents, evaluation, feedback, landscape, merge, reports, retrieval, versions
from spindrift.sources import events, trials
from spindrift.streaming import sessions

NOW = dt.datetime(2024, 1, 31)


def trial(**own):
    return tuple(own.get(c, 0 if c in trials.COUNTS else "") for c in trials.COLUMNS)


@pytest.fixture
def corpus(spark):
    rows = [
        trial(nctId="N1", bTitle="CDK4/6 in breast cancer", phases="PHASE2", oStatus="RECRUITING", sponsorClass="NIH", interventionName="Palbociclib", interventionType="drug, DRUG", locationCountries="United States", conditions="Breast Cancer"),
        trial(nctId="N2", bTitle="Immunotherapy in breast cancer", phases="PHASE2", oStatus="COMPLETED", sponsorClass="INDUSTRY", interventionName="Pembrolizumab", interventionType="DRUG", locationCountries="United States, Japan", conditions="TNBC"),
        trial(nctId="N3", bTitle="Lung study", phases="", oStatus="RECRUITING", interventionName="Trastuzumab Deruxtecan"),
    ]
    return documents.build_documents(spark.createDataFrame(rows, trials.TRIAL))


def test_documents(corpus):
    first = {r["doc_id"]: r for r in corpus.collect()}
    assert first["N1"]["text"].split("\n")[:2] == ["Title: CDK4/6 in breast cancer", "Conditions: Breast Cancer"]
    assert first["N3"]["drug_classes"] == ["ADC (antibody-drug conjugate)", "HER2-targeted therapy"]
    assert first["N1"]["enrollmentCont"] == 0


def test_landscape(corpus):
    rows = {(r["section"], r["label"]): r["count"] for r in landscape.landscape(corpus, r"breast[\s\-]*cancer", phase="PHASE2").collect()}
    assert rows[("totals", "population_total")] == 2 and rows[("totals", "total")] == 2
    assert rows[("intervention_type", "DRUG")] == 3 and rows[("geography", "United States")] == 2 and rows[("geography", "Japan")] == 1
    assert rows[("drug_class", "CDK4/6 inhibitor")] == 1 and rows[("status", "COMPLETED")] == 1
    assert landscape.landscape(corpus, None).count() == 0
    assert landscape.landscape(corpus, None, status="SUSPENDED").filter("section <> 'totals'").count() == 0


def test_context(spark):
    rows = spark.createDataFrame([("N2", 2, "b", "0"), ("N1", 1, "a", "x")], "doc_id string, rank int, title string, extra string")
    text = documents.context(rows, {"title": "Title", "extra": "Extra"}).head()[0]
    assert text.index("N1") < text.index("N2") and "Extra: x" in text and "Extra: 0" not in text


def test_decayed_scores(spark):
    votes = spark.createDataFrame(
        [("rating_up", NOW, ["A"]), ("rating_up", NOW, ["A", "B"]), ("rating_down", NOW, ["A"]), ("rating_up", NOW - dt.timedelta(days=30), ["C"]), ("rating_up", NOW + dt.timedelta(days=9), ["D"]), ("correction", NOW, ["E"]), ("rating_up", NOW, [])],
        "type string, ts timestamp, ids array<string>",
    )
    got = {r["doc_id"]: r["net"] for r in feedback.source_scores(votes, F.lit("2024-01-31").cast("timestamp")).collect()}
    assert got == pytest.approx({"A": 0.5, "B": 1.0, "C": 0.5, "D": 1.0}, abs=1e-6)


@pytest.mark.parametrize("scores, nets, order", [((0.50, 0.49), (-5.0, 1.0), ["b", "a"]), ((0.95, 0.45), (-10.0, 0.0), ["a", "b"])])
def test_rerank(spark, scores, nets, order):
    ranked = spark.createDataFrame([("a", scores[0], 1), ("b", scores[1], 2)], "doc_id string, score double, rank int")
    net = spark.createDataFrame(list(zip("ab", nets, strict=True)), "doc_id string, net double")
    assert [r["doc_id"] for r in feedback.reranked(ranked, net).collect()] == order


def test_rerank_cap(spark):
    ranked = spark.createDataFrame([("a", 0.5, 1)], "doc_id string, score double, rank int")
    assert feedback.reranked(ranked, spark.createDataFrame([("a", 1000.0)], "doc_id string, net double")).head()["score"] == pytest.approx(0.55, abs=1e-6)


def test_examples_aliases_and_log(spark):
    schema = "type string, context struct<query: string, assistant_message: string>"
    rows = [("rating_up", ("q", "x" * 300)), ("rating_down", ("q", "x" * 300)), ("rating_up", ("q", "short")), ("rating_up", (" ", "x" * 300))]
    assert feedback.examples(spark.createDataFrame(rows, schema)).count() == 1
    aliases = feedback.upserted_alias(spark.createDataFrame([("tdxd", "x")], "alias string, canonical string"), " TDXD ", "Trastuzumab deruxtecan")
    assert [tuple(r) for r in aliases.collect()] == [("tdxd", "Trastuzumab deruxtecan")]
    with pytest.raises(ValueError):
        feedback.upserted_alias(aliases, " ", "x")
    log = spark.createDataFrame([("1", "2024-01-01", "open"), ("1", "2024-01-02", "resolved")], "id string, created_at string, status string")
    assert feedback.latest_status(log).head()["status"] == "resolved"


def brute_round_robin(pool, budget):
    by = {}
    for i, (_, classes) in enumerate(pool):
        for c in classes or ["(other)"]:
            by.setdefault(c, []).append(i)
    chosen = []
    while len(chosen) < budget:
        before = len(chosen)
        for c in sorted(by, key=lambda c: by[c][0]):
            rest = [i for i in by[c] if i not in chosen]
            if rest and len(chosen) < budget:
                chosen.append(rest[0])
        if len(chosen) == before:
            break
    return [pool[i][0] for i in sorted(chosen)]


def test_diversified(spark):
    pool = [("a", ["x", "y"]), ("b", ["x"]), ("c", []), ("d", ["y", "z"]), ("e", ["z"]), ("f", ["x"]), ("g", [])]
    rows = spark.createDataFrame([(1, d, i, c) for i, (d, c) in enumerate(pool)], "qid long, doc_id string, rank int, classes array<string>")
    for budget in (0, 1, 3, 5, 9):
        got = [r["doc_id"] for r in retrieval.diversified(rows, budget).orderBy("rank").collect()]
        assert got == brute_round_robin(pool, budget)


def test_filter_ladder(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "i int")
    keep = lambda s, x: sorted(r["i"] for r in retrieval.filter_ladder(rows, s, x).collect())
    assert keep(F.col("i") == 3, F.col("i") > 1) == [3]
    assert keep(F.col("i") == 9, F.col("i") > 3) == [4, 5]
    assert keep(F.col("i") == 9, F.col("i") == 9) == [0, 1, 2, 3, 4, 5]
    assert [retrieval.pool_size(5, *a) for a in ((True, False, False), (False, True, False), (False, False, True), (False, False, False))] == [200, 50, 20, 5]


def test_sparse_retrieval(spark):
    docs = spark.createDataFrame([("1", "cdk4 inhibitor palbociclib"), ("2", "immunotherapy for tnbc"), ("3", None)], "id string, text string")
    counts = retrieval.term_counts(docs, "id", "text", stop_words=["for"], bigrams=True)
    terms = retrieval.vocabulary(counts, 3)
    asked = retrieval.term_counts(spark.createDataFrame([("q", "immunotherapy tnbc")], "id string, text string"), "id", "text", bigrams=True)
    top = retrieval.top_k(retrieval.sparse_scores(retrieval.weighted(asked, terms), retrieval.weighted(counts, terms)), 5).collect()
    assert [r["doc_id"] for r in top] == ["2"] and top[0]["score"] == pytest.approx(1.0)


def test_encoded(spark):
    docs = spark.createDataFrame([("1", "ab"), ("2", None)], "doc_id string, text string")
    got = {r["doc_id"]: r["embedding"] for r in retrieval.encoded(docs, lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts], 2).collect()}
    assert got["1"] == pytest.approx([0.6, 0.8]) and got["2"] == [0.0, 0.0]


def test_conversation_waits_for_disease(spark):
    turns = spark.createDataFrame([(1, 0, "user", "phase 2"), (1, 1, "assistant", "TNBC"), (1, 2, "user", "TNBC"), (1, 3, "user", "phase 3")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in landscape.merged_filters(turns).orderBy("turn").collect()]
    name = "Triple-Negative Breast Cancer (TNBC)"
    assert got == [(1, 0, None, None, None), (1, 2, name, "PHASE2", None), (1, 3, name, "PHASE3", None)]
    changed = conversation.changed_turns(landscape.merged_filters(turns), ["disease", "phase", "status"]).orderBy("turn").collect()
    assert [r["changed"] for r in changed] == [False, True, True]


def test_versions(spark):
    schema = "user_id string, protocol_id string, version int, title string, ts string"
    store = spark.createDataFrame([("u", "p", 1, "a", "1"), ("u", "p", 2, "b", "2"), ("v", "p", 1, "c", "9")], schema)
    new = versions.next_versions(store, spark.createDataFrame([("u", "p", "z"), ("u", "new", "z")], "user_id string, protocol_id string, title string"), ["user_id", "protocol_id"])
    assert {(r["protocol_id"], r["version"]) for r in new.collect()} == {("p", 3), ("new", 1)}
    assert [(r["protocol_id"], r["version"], r["title"]) for r in versions.listed(store, "u").collect()] == [("p", 2, "b")]
    assert [(r["field"], r["value_a"], r["value_b"]) for r in versions.diff(store.filter("user_id = 'u'"), ["protocol_id"], ["title"]).collect()] == [("title", "a", "b")]
    notes = spark.createDataFrame([("p", 2, "ask", "done")], "protocol_id string, version int, user_request string, assistant_note string")
    assert [r["user_request"] for r in versions.with_notes(store.filter("user_id = 'u'"), notes, ["protocol_id"]).orderBy("version").collect()] == ["", "ask"]


def test_merge(spark):
    old = spark.createDataFrame([("a", "0"), ("b", "1")], "k string, v string")
    new = spark.createDataFrame([("a", 0), ("b", 2), ("c", 3)], "k string, v int")
    got = {r["k"]: r["change"] for r in merge.changes(old, new, "k").collect()}
    assert got == {"a": "S", "b": "U", "c": "I"}
    assert sorted(tuple(r) for r in merge.upserted(old, new, "k").collect()) == [("a", "0"), ("b", "2"), ("c", "3")]


def test_reports_share_the_boundary(spark):
    at = NOW - dt.timedelta(days=7)
    rows = spark.createDataFrame([(at, "query_received", "u", "s"), (NOW, "query_received", None, "t")], "timestamp timestamp, event_type string, user_id string, session_id string")
    r = reports.headline(rows, F.lit("2024-01-31").cast("timestamp")).head()
    assert (r["queries_this"], r["queries_prev"], r["wau_this"], r["wau_prev"]) == (2, 1, 1, 1)
    n = reports.new_and_returning(rows, F.lit("2024-01-31").cast("timestamp")).head()
    assert (n["new_users"], n["returning_users"]) == (2, 0)


def test_evaluation(spark):
    rows = spark.createDataFrame([("c", "palbociclib trial", ["Palbociclib", "x", "y"]), ("c", "other", ["Palbociclib"])], "category string, text string, keywords array<string>")
    assert [r["relevant"] for r in evaluation.keyword_relevance(rows, F.col("text")).collect()] == [True, False]
    verdicts = spark.createDataFrame([('{"faithfulness": 4, "relevance": 5, "completeness": 3}',), ("broken",)], "verdict string")
    assert tuple(evaluation.judged(verdicts).head()) == (2.0, 2.5, 1.5, 2.0)


def test_csv_round_trip(spark, tmp_path):
    rows = [trial(nctId="N1", bTitle='a "quoted"\nline, with comma', phases="NA", enrollmentCont=5), trial(nctId="N2", masking="N/A")]
    trials.write_csv(spark.createDataFrame(rows, trials.TRIAL), str(tmp_path / "t"))
    got = {r["nctId"]: r for r in trials.read_csv(spark, str(tmp_path / "t")).collect()}
    assert got["N1"]["bTitle"] == 'a "quoted"\nline, with comma' and got["N1"]["phases"] == "" and got["N1"]["enrollmentCont"] == 5 and got["N2"]["masking"] == ""


def test_studies(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"protocolSection": {"identificationModule": {"nctId": "N1"}, "contactsLocationsModule": {"overallOfficials": [{"name": "A", "role": "STUDY_CHAIR", "affiliation": "X"},'
        ' {"name": "B", "role": "PRINCIPAL_INVESTIGATOR", "affiliation": "Y"}], "locations": [{"city": "Rome", "country": "Italy"}, {"country": "France"}, {"country": "Italy"}]},'
        ' "armsInterventionsModule": {"interventions": [{"name": "D", "otherNames": ["E", "F"]}, {"type": "DRUG"}], "armGroups": [{"label": "L", "type": "T", "description": "Z"}]},'
        ' "eligibilityModule": {"eligibilityCriteria": "Inclusion Criteria: a Exclusion Criteria: b", "healthyVolunteers": false}}}\nbroken\n{"protocolSection": {}}\n'
    )
    rows = trials.read_studies(spark, str(tmp_path / "s.json")).collect()
    r = next(x for x in rows if x["nctId"] == "N1")
    assert (r["piName"], r["piAffiliation"], r["locationCountries"], r["locationCount"]) == ("B", "Y", "France, Italy", 3)
    assert (r["interventionName"], r["interventionType"], r["interventionOtherNames"], r["armGroups"]) == ("D", "DRUG", "E, F", "L: T - Z")
    assert (r["includeCriteria"], r["healthyVolunteers"], r["sex"]) == ("Inclusion Criteria: a", "False", "ALL")
    assert r["locationInfo"].startswith("N/A (N/A) - Rome, N/A, Italy")


def test_events_and_latest(spark):
    log = spark.createDataFrame([("t", '{"event_type": "a", "latency_ms": "x", "num_sources": 3}'), ("t", "{}"), ("t", "broken")], "timestamp string, text_payload string")
    got = events.typed(log).collect()
    assert [(r["event_type"], r["latency_ms"], r["num_sources"]) for r in got] == [("a", None, 3)]
    text = spark.range(1).select(events.payload({"event_type": F.lit("a"), "query_text": F.lit("x" * 3000), "none": F.lit(None).cast("string")})).head()[0]
    assert "none" not in text and "…" in text and len(text) < 2100
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("", 3, "z")], "nctId string, pos int, v string")
    assert [r["v"] for r in trials.latest_by_key(rows).collect()] == ["y"]
    names = events.aliases_from_json(spark.createDataFrame([('{" TDXD ": " T-DXd ", "": "x"}',)], "value string"))
    assert [tuple(r) for r in names.collect()] == [("tdxd", "T-DXd")]


def test_session_windows_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 10, 0)), (1, dt.datetime(2024, 1, 1, 10, 20)), (1, dt.datetime(2024, 1, 1, 12, 0)), (2, dt.datetime(2024, 1, 1, 10, 0))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))  # in one file: rows of later files may come after the watermark
    stream = sessions.session_windows(sessions.read_events(spark, str(tmp_path / "e"), df.schema))
    got = sessions.run_once(stream, "windows_test").collect()
    assert sorted((r["user_id"], r["event_count"]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_rows_taken_up_again(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 10, 0)), (1, dt.datetime(2024, 1, 1, 12, 0)), (2, dt.datetime(2024, 1, 1, 11, 0)), (1, dt.datetime(2024, 1, 2, 9, 0))]
    late = sessions.overlapping(spark.createDataFrame(rows, "user_id long, ts timestamp"), F.lit("2024-01-02").cast("timestamp"), "13 hours")
    assert late.count() == 3


def test_retrieval_without_broadcast_and_in_blocks(spark):
    rng = __import__("numpy").random.default_rng(2)
    vectors = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(60)], "doc_id long, e array<double>").select("doc_id", retrieval.normalised(F.col("e")).alias("v"))
    queries = vectors.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("q"))
    plain = retrieval.top_k(retrieval.dense_scores(queries, vectors).filter("qid <> doc_id").withColumn("score", F.round("score", 6)), 4)
    want = sorted((r["qid"], r["rank"], r["doc_id"]) for r in plain.collect())
    for pack, at_once in ((3, 2), (5, 1), (2048, 16)):
        assert sorted((r["qid"], r["rank"], r["doc_id"]) for r in retrieval.dense_top_k(queries, vectors, 4, query_pack=pack, at_once=at_once).collect()) == want
    postings = spark.createDataFrame([("d1", "a", 0.5), ("d1", "b", 0.5), ("d2", "a", 1.0)], "doc_id string, term string, w double")
    asked = spark.createDataFrame([("q", "a", 1.0)], "doc_id string, term string, w double")
    both = [sorted(map(tuple, retrieval.sparse_scores(asked, postings, few=n).collect())) for n in (0, 100)]
    assert both[0] == both[1] == [("q", "d1", 0.5), ("q", "d2", 1.0)]
