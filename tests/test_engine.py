import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import documents
from spindrift.plans.engine import Engine, FeedbackStore, ProtocolStore, fingerprint
from spindrift.sources import trials


def trial(**own):
    return tuple(own.get(c, 0 if c in trials.COUNTS else "") for c in trials.COLUMNS)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        trial(nctId="N1", bTitle="CDK4/6 inhibitor in breast cancer", phases="PHASE2", oStatus="RECRUITING", sponsorName="National Cancer Institute", sponsorClass="NIH", interventionName="Palbociclib", interventionOtherNames="IBRANCE", locationCountries="United States"),
        trial(nctId="N2", bTitle="Immunotherapy in TNBC breast cancer", phases="PHASE2", oStatus="RECRUITING", sponsorName="Merck Sharp & Dohme", sponsorClass="INDUSTRY", interventionName="Pembrolizumab", locationCountries="United States"),
        trial(nctId="N3", bTitle="Antibody drug in breast cancer", phases="PHASE3", oStatus="COMPLETED", sponsorName="Daiichi Sankyo", sponsorClass="INDUSTRY", interventionName="Trastuzumab Deruxtecan", locationCountries="United States, United Kingdom"),
    ]
    return Engine(documents.build_documents(spark.createDataFrame(rows, trials.TRIAL)))


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_search(engine):
    assert ids(engine.search("CDK4/6 inhibitor", 1)) == ["N1"]
    assert ids(engine.search("immunotherapy TNBC", 1)) == ["N2"]
    assert ids(engine.search("Daiichi Sankyo trials in breast cancer")) == ["N3"]
    assert ids(engine.search("breast cancer in the United Kingdom")) == ["N3"]
    assert len(ids(engine.search("breast cancer in Japan"))) == 3  # a filter that leaves nothing is dropped
    assert ids(engine.search("breast cancer trials with ADC or checkpoint inhibitor")) and ids(engine.search("zzz")) == []
    with pytest.raises(ValueError):
        engine.search("x", 0)


def test_feedback_moves_results(engine, spark):
    votes = spark.createDataFrame([("N2", 9.0)], "doc_id string, net double")
    assert set(ids(engine.search("breast cancer", 3, votes))) == {"N1", "N2", "N3"}


def test_chat_orders_by_tier(engine, spark):
    got = ids(engine.chat("breast cancer", {"disease": "Breast Cancer (general)", "phase": "PHASE2"}))
    assert got == ["N2", "N1"]
    aliases = spark.createDataFrame([("ibrance", "Palbociclib")], "alias string, canonical string")
    assert ids(engine.chat("ibrance", {}, k=1, aliases=aliases)) == ["N1"]
    assert engine.landscape({"disease": "Breast Cancer (general)"}).filter("label = 'total'").head()["count"] == 3


def test_corpora_and_fingerprint(engine, spark):
    got = {r["corpus"]: r for r in Engine.corpora(spark, spark.createDataFrame([("melanoma",)], "corpus string")).collect()}
    assert len(got) == 13 and got["melanoma"]["trial_count"] == 1 and not got["lymphoma"]["loaded"]
    a, b = (fingerprint(df.select("doc_id", "text")).head() for df in (engine.docs, engine.docs.orderBy(F.desc("doc_id"))))
    assert a == b


def test_protocols(spark, tmp_path):
    schema = "protocol_id string, version int, ts string, title string, conditions string, user_id string"
    store = ProtocolStore(spark, str(tmp_path / "p"), schema)
    row = lambda p, ts, title, user="u": spark.createDataFrame([(p, ts, title, "", user)], "protocol_id string, ts string, title string, conditions string, user_id string")
    store.save(row("a", "1", "palbociclib in breast"))
    store.save(row("b", "2", "lung study"))
    store.save(row("a", "3", "palbociclib revised"), must_exist=True)
    store.save(row("a", "9", "of another user", "v"))
    assert [(r["protocol_id"], r["version"]) for r in store.list("u").collect()] == [("a", 2), ("b", 1)]
    assert store.load("u", "a", 1).head()["title"] == "palbociclib in breast" and store.load("u", "a").head()["version"] == 2
    assert [r["protocol_id"] for r in store.matching("u", "the lung one", ["title"]).collect()] == ["b", "a"]
    with pytest.raises(KeyError):
        store.save(row("zz", "1", "x"), must_exist=True)


def test_feedback_store(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "f"))
    store.append(spark.createDataFrame([("1", "rating_up")], "id string, type string"), "2024-01-01")
    assert store.set_status("1", "resolved", "2024-01-02") and not store.set_status("9", "open", "2024-01-02")
    assert [(r["id"], r["status"]) for r in store.read().collect()] == [("1", "resolved")]


def test_replies(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\nCHANGES: x, y ,\nNOTE: done\n```',), ("{}",)], "raw string")
    body, changed, note = X.refined_reply(F.col("raw"))
    assert [tuple(r) for r in df.select(body, changed, note).collect()] == [('{"a": 1}', ["x", "y"], "done"), ("{}", [], "")]
    df = spark.createDataFrame([("Pick:\n[CHOICES]\n- one\n- two\nx\n[/CHOICES]",), ("[APPLY_PROTOCOL_CHANGES] apply: 1, 3 [/APPLY_PROTOCOL_CHANGES] ok",)], "t string")
    first, second = df.select(*X.choices(F.col("t")), *X.apply_directive(F.col("t"))).collect()
    assert (first[0], first[1], first[3]) == ("Pick:", ["one", "two"], None) and (second[2], second[3]) == ("ok", "1, 3")
    assert spark.range(1).select(X.markup_escaped(F.lit("<a&'b'>"))).head()[0] == "&lt;a&amp;&#39;b&#39;&gt;"
