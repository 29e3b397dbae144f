"""Rows that are written out here, with the values that must result: expressions over query texts, trial records and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import constants as K
from spindrift.functions import text as X
from spindrift.operators import conversation, documents, feedback, landscape, merge, versions
from spindrift.sources import trials

QUERIES, EXPECTED = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__], EXPECTED[f.__name__] = f, sql
        return f

    return add


EMPTY = ""


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]" if value else "CAST([] AS VARCHAR[])"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL that lists the rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({columns})"


#: Query text; classes named, setting, study type, population, phase, status; whether it asks for an earlier protocol, and confirms.
_INTENTS = [
    ("ADC trials in TNBC, phase 2", ["ADC (antibody-drug conjugate)"], None, None, "Triple-Negative Breast Cancer (TNBC)", "PHASE2", None, False, False),
    ("neoadjuvant checkpoint inhibitors for HER2-positive disease", ["PD-(L)1 / immune checkpoint"], "neoadjuvant", None, "HER2+ Breast Cancer", None, None, False, False),
    ("adjuvant CDK4/6 inhibitor, hormone receptor positive", ["CDK4/6 inhibitor"], "adjuvant", None, "HR+ Breast Cancer", None, None, False, False),
    ("observational studies of metastatic breast cancer", [], "metastatic", "OBSERVATIONAL", "Breast Cancer (general)", None, None, False, False),
    ("Phase III PARP inhibitor with platinum chemotherapy, not yet recruiting", ["Platinum chemotherapy", "PARP inhibitor"], None, None, None, "PHASE3", "NOT_YET_RECRUITING", False, False),
    ("early-stage ductal carcinoma in situ, completed", [], "adjuvant", None, "Ductal Carcinoma in Situ (DCIS)", None, "COMPLETED", False, False),
    ("based on the previous protocol, make it interventional", [], None, "INTERVENTIONAL", None, None, None, True, False),
    ("Yes, please apply the changes!", [], None, None, None, None, None, False, True),
    ("apply 1, 2 and 3", [], None, None, None, None, None, False, True),
    ("apply for a grant", [], None, None, None, None, None, False, False),
    ("expanded access for early phase 1 taxanes", ["Taxane chemotherapy"], "adjuvant", "EXPANDED_ACCESS", None, "EARLY_PHASE1", None, False, False),
    ("active, not recruiting: phase iv in male breast cancer", [], None, None, "Male Breast Cancer", "PHASE4", "ACTIVE_NOT_RECRUITING", False, False),
    ("", [], None, None, None, None, None, False, False),
]


@query(expected("text, classes, setting, study_type, disease, phase, status, earlier, confirmed", _INTENTS))
def text_intents(spark, sf_dir):
    t = F.col("text")
    return spark.createDataFrame([(r[0],) for r in _INTENTS], "text string").select(
        "text", X.drug_classes_named(t).alias("classes"), X.setting_intent(t).alias("setting"), X.study_type(t).alias("study_type"), X.disease(t).alias("disease"),
        X.phase(t).alias("phase"), X.one_status(t).alias("status"), X.asks_for_earlier_protocol(t).alias("earlier"), X.confirms(t).alias("confirmed"),
    )


_WIDENED = [
    ("PARP inhibitor in TNBC", "PARP inhibitor in TNBC Olaparib Talazoparib Niraparib"),
    ("olaparib as a PARP inhibitor", "olaparib as a PARP inhibitor Talazoparib Niraparib"),
    ("taxane then anthracycline", "taxane then anthracycline Doxorubicin Epirubicin Paclitaxel Nab-paclitaxel Docetaxel"),
    ("aspirin", "aspirin"),
]


@query(expected("text, widened", _WIDENED))
def class_expansion(spark, sf_dir):
    return spark.createDataFrame([(r[0],) for r in _WIDENED], "text string").select("text", X.with_drugs(F.col("text"), X.drug_classes_named(F.col("text"))).alias("widened"))


_CRITERIA = [
    ("Inclusion Criteria: adults Exclusion Criteria: pregnancy", "Inclusion Criteria: adults", "Exclusion Criteria: pregnancy"),
    ("Inclusion Criteria: adults only ", "Inclusion Criteria: adults only", EMPTY),
    ("Exclusion Criteria: x Inclusion Criteria: y", EMPTY, "Exclusion Criteria: x Inclusion Criteria: y"),
    ("any adult", "any adult", EMPTY),
    (None, EMPTY, EMPTY),
]


@query(expected("text, including, excluding", _CRITERIA))
def criteria_split(spark, sf_dir):
    including, excluding = X.criteria(F.col("text"))
    return spark.createDataFrame([(r[0],) for r in _CRITERIA], "text string").select("text", including.alias("including"), excluding.alias("excluding"))


_REPLIES = [
    ("Pick:\n[CHOICES]\n- one\n- two\nx\n[/CHOICES]", "Pick:", ["one", "two"], "Pick:\n[CHOICES]\n- one\n- two\nx\n[/CHOICES]", None),
    ("[APPLY_PROTOCOL_CHANGES] apply: 1, 3 [/APPLY_PROTOCOL_CHANGES] ok", "[APPLY_PROTOCOL_CHANGES] apply: 1, 3 [/APPLY_PROTOCOL_CHANGES] ok", [], "ok", "1, 3"),
    ("plain", "plain", [], "plain", None),
]


@query(expected("text, shown, choices, rest, applied", _REPLIES))
def reply_tags(spark, sf_dir):
    (shown, choices), (rest, applied) = X.choices(F.col("text")), X.apply_directive(F.col("text"))
    rows = spark.createDataFrame([(r[0],) for r in _REPLIES], "text string")
    return rows.select("text", shown.alias("shown"), choices.alias("choices"), rest.alias("rest"), applied.alias("applied"))


_RENDERED = [
    (1, "<a&'b'>", "&lt;a&amp;&#39;b&#39;&gt;", "a b/c", "a_b_c", "just now", "v1 (original)", " My title ", "My title"),
    (2, 'say "x"', "say &quot;x&quot;", "  ", "anonymous", "5m ago", "v2", "", "protocol"),
    (3, "", "", "u.1-2_3", "u.1-2_3", "3h ago", "v3", None, "protocol"),
    (4, "&amp;", "&amp;amp;", None, "anonymous", "2d ago", "v4", "a", "a"),
    (5, "plain", "plain", "ü", "_", "2023-11-01", "v5", "b", "b"),
]
_AGES = {1: "2024-01-31 11:59:40", 2: "2024-01-31 11:54:30", 3: "2024-01-31 08:30:00", 4: "2024-01-29 10:00:00", 5: "2023-11-01 09:00:00"}


@query(expected("id, raw, escaped, user_id, user_key, age, label, title, file", _RENDERED))
def rendered_texts(spark, sf_dir):
    """Escaped markup, user keys, ages, version labels and file names."""
    rows = spark.createDataFrame([(r[0], r[1], r[3], _AGES[r[0]], r[7]) for r in _RENDERED], "id int, raw string, user_id string, ts string, title string")
    age = X.age_text(F.col("ts").cast("timestamp"), F.lit("2024-01-31 12:00:00").cast("timestamp"))
    return rows.select(
        "id", "raw", X.markup_escaped(F.col("raw")).alias("escaped"), "user_id", X.user_key(F.col("user_id")).alias("user_key"), age.alias("age"), X.version_label(F.col("id")).alias("label"),
        "title", X.file_name(F.col("title")).alias("file"),
    )


_ASKED = [
    ("any phase 2 trials?", "HER2-Low Breast Cancer", "HER2-Low Breast Cancer — any phase 2 trials?"), ("TNBC trials", "HER2-Low Breast Cancer", "TNBC trials"), ("trials", "", "trials"), ("trials", None, "trials"),
]


@query(expected("text, population, asked", _ASKED))
def query_with_population(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in _ASKED], "text string, population string")
    return rows.select("text", "population", X.with_population(F.col("text"), F.col("population")).alias("asked"))


def _trial(**own):
    return tuple(own.get(c, 0 if c in trials.COUNTS else "") for c in trials.COLUMNS)


def _documents(spark):
    rows = [
        _trial(nctId="N1", bTitle=" Palbociclib in early breast cancer ", phases="PHASE2", oStatus="RECRUITING", studyType="INTERVENTIONAL", sponsorName="Pfizer Inc", interventionName="Palbociclib", locationCountries="United States, Japan", locationInfo="A (x) - Boston, Massachusetts, United States", enrollmentCont=30, locationCount=2),
        _trial(nctId="N2", bTitle="Antibody drug for advanced disease", conditions="Metastatic Breast Cancer", phases="PHASE3", oStatus="COMPLETED", studyType="OBSERVATIONAL", sponsorName="Merck Sharp & Dohme", interventionName="Trastuzumab deruxtecan", interventionOtherNames="ENHERTU", locationCountries="United Kingdom"),
        _trial(nctId="N3", oTitle="Neoadjuvant chemotherapy", interventionName="Paclitaxel, Carboplatin", summary="long " * 200),
    ]
    return documents.build_documents(spark.createDataFrame(rows, trials.TRIAL))


_BUILT = [
    ("N1", "Title: Palbociclib in early breast cancer\nIntervention: Palbociclib\nPhase: PHASE2\nStatus: RECRUITING\nStudy Type: INTERVENTIONAL\nSponsor: Pfizer Inc\nLocation: A (x) - Boston, Massachusetts, United States\nCountries: United States, Japan", "Palbociclib in early breast cancer", "PHASE2", "RECRUITING", 30, 2, ["CDK4/6 inhibitor"]),
    ("N2", "Title: Antibody drug for advanced disease\nConditions: Metastatic Breast Cancer\nIntervention: Trastuzumab deruxtecan\nDrug Aliases: ENHERTU\nPhase: PHASE3\nStatus: COMPLETED\nStudy Type: OBSERVATIONAL\nSponsor: Merck Sharp & Dohme\nCountries: United Kingdom", "Antibody drug for advanced disease", "PHASE3", "COMPLETED", 0, 0, ["ADC (antibody-drug conjugate)", "HER2-targeted therapy"]),
    ("N3", "Official Title: Neoadjuvant chemotherapy\nSummary: " + ("long " * 200).strip() + "\nIntervention: Paclitaxel, Carboplatin", "", "", "", 0, 0, ["Taxane chemotherapy", "Platinum chemotherapy"]),
]


@query(expected("doc_id, text, title, phases, status, enrollment, locations, drug_classes", _BUILT))
def trial_documents(spark, sf_dir):
    return _documents(spark).select("doc_id", "text", "title", "phases", "status", F.col("enrollmentCont").alias("enrollment"), F.col("locationCount").alias("locations"), "drug_classes")


_FILTERED = [
    ("N1", True, False, True, False, True, False, True, False, True, True, True),
    ("N2", False, False, False, True, False, True, False, True, False, False, True),
    ("N3", False, False, False, False, False, False, True, False, False, False, False),
]


@query(expected("doc_id, in_japan, in_texas, in_massachusetts, observational, recruiting, by_merck, early, metastatic, second_phase, cdk, cdk_or_adc", _FILTERED))
def document_filters(spark, sf_dir):
    """What structured filters of a query keep, over documents of trials."""
    places, setting = F.coalesce(X.or_null(F.col("locationInfoFull")), F.col("locationInfo")), documents.setting_text()
    own = F.col("drug_classes")
    return _documents(spark).select(
        "doc_id", X.holds_any(F.col("locationCountries"), ["Japan"]).alias("in_japan"), X.holds_any(places, ["Texas"]).alias("in_texas"), X.holds_any(places, ["Massachusetts"]).alias("in_massachusetts"),
        (F.upper("studyType") == "OBSERVATIONAL").alias("observational"), F.upper("status").isin("RECRUITING").alias("recruiting"), X.holds_any(F.col("sponsorName"), ["merck"]).alias("by_merck"),
        X.matches_setting(setting, "adjuvant").alias("early"), X.matches_setting(setting, "metastatic").alias("metastatic"), (X.cleaned(F.col("phases")) == "PHASE2").alias("second_phase"),
        X.has_all(own, ["CDK4/6 inhibitor"]).alias("cdk"), X.has_any(own, ["CDK4/6 inhibitor", "ADC (antibody-drug conjugate)"]).alias("cdk_or_adc"),
    )


_CARDS = [("N1", "Palbociclib in early breast cancer", 0.5, "RECRUITING", "Palbociclib", "30", "Pfizer Inc", 2, 31), ("N2", "Antibody drug for advanced disease", 0.5, "COMPLETED", "Trastuzumab deruxtecan", "0", "Merck Sharp & Dohme", 0, 31), ("N3", "", 0.5, "", "Paclitaxel, Carboplatin", "0", "", 0, 31)]


@query(expected("nct_id, title, score, status, intervention, enrollment, sponsor, location_count, n_fields", _CARDS))
def source_cards(spark, sf_dir):
    card = documents.source_card(_documents(spark).withColumn("nctId", F.col("doc_id")).withColumn("score", F.lit(0.5)))
    return card.select("nct_id", "title", "score", "status", "intervention", "enrollment", "sponsor", "location_count", F.lit(len(card.columns)).alias("n_fields"))


_STUDY = (
    '{"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "contactsLocationsModule": {"overallOfficials": [{"name": "A", "role": "STUDY_CHAIR", "affiliation": "X"},'
    ' {"name": "B", "role": "PRINCIPAL_INVESTIGATOR", "affiliation": "Y"}], "locations": [{"city": "Rome", "country": "Italy"}, {"country": "France"}, {"country": "Italy"}]},'
    ' "armsInterventionsModule": {"interventions": [{"name": "D", "type": "DRUG", "otherNames": ["E", "F"]}, {"type": "DEVICE"}], "armGroups": [{"label": "L", "type": "T", "description": "Z"}]},'
    ' "eligibilityModule": {"eligibilityCriteria": "Inclusion Criteria: a Exclusion Criteria: b", "healthyVolunteers": false}, "designModule": {"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 12}}}}',
    '{"protocolSection": {"identificationModule": {"nctId": "N2"}, "contactsLocationsModule": {"overallOfficials": [{"name": "C", "role": "STUDY_CHAIR"}]}}}',
)
_PARSED = [
    ("N1", "T", "B", "Y", "France, Italy", 3, "D", "DRUG, DEVICE", "E, F", "L: T - Z", "Inclusion Criteria: a", "Exclusion Criteria: b", "False", "PHASE1, PHASE2", 12, "ALL"),
    ("N2", "", "C", "", "", 0, "", "", "", "", "", "", "", "", 0, "ALL"),
]


@query(expected("nctId, bTitle, piName, piAffiliation, locationCountries, locationCount, interventionName, interventionType, interventionOtherNames, armGroups, includeCriteria, excludeCriteria, healthyVolunteers, phases, enrollmentCont, sex", _PARSED))
def nested_studies(spark, sf_dir):
    parsed = spark.createDataFrame([(s,) for s in _STUDY], "value string").select(F.from_json("value", trials.STUDY).alias("s")).select("s.*")
    return trials.parse_studies(parsed).select("nctId", "bTitle", "piName", "piAffiliation", "locationCountries", "locationCount", "interventionName", "interventionType", "interventionOtherNames", "armGroups", "includeCriteria", "excludeCriteria", "healthyVolunteers", "phases", "enrollmentCont", "sex")


_SNAPSHOT = [("N1", "b", 2), ("N2", "c", 1)]


@query(expected("nctId, v, pos", _SNAPSHOT))
def latest_snapshot(spark, sf_dir):
    """The last row of each key; rows without a key go."""
    rows = [("N1", "a", 1), ("N1", "b", 2), ("N2", "c", 1), ("", "d", 9), (None, "e", 9)]
    return trials.latest_by_key(spark.createDataFrame(rows, "nctId string, v string, pos int"))


@query(expected("k, v", [("a", "0"), ("b", "3"), ("c", "4"), ("d", None)]))
def upsert_with_other_types(spark, sf_dir):
    """Numbers into a snapshot of texts; the last of repeated rows counts."""
    old = spark.createDataFrame([("a", "x"), ("b", "1")], "k string, v string")
    return merge.upserted(old, spark.createDataFrame([("a", 0), ("b", 2), ("b", 3), ("c", 4), ("d", None)], "k string, v int"), "k")


@query(expected("doc_id, first", [("a", 1.0), ("c", 3.0)]))
def embedding_refresh(spark, sf_dir):
    """Stored vectors after an update: new ones replace, those of deleted documents go."""
    store = spark.createDataFrame([("a", [9.0]), ("b", [2.0])], "doc_id string, embedding array<float>")
    ids = spark.createDataFrame([("a",), ("c",)], "doc_id string")
    made = merge.refreshed(store, spark.createDataFrame([("a", [1.0]), ("c", [3.0])], "doc_id string, embedding array<float>"), ids)
    return made.select("doc_id", F.col("embedding")[0].cast("double").alias("first"))


_TURNS = [(1, 0, None, None, None), (1, 2, "Triple-Negative Breast Cancer (TNBC)", "PHASE2", None), (1, 3, "Triple-Negative Breast Cancer (TNBC)", "PHASE3", "RECRUITING")]


@query(expected("conv_id, turn, disease, phase, status", _TURNS))
def filters_of_turns(spark, sf_dir):
    turns = [(1, 0, "user", "phase 2"), (1, 1, "assistant", "TNBC"), (1, 2, "user", "TNBC"), (1, 3, "user", "phase 3, recruiting")]
    return landscape.merged_filters(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))


@query(expected("query, answer", [("q1", "a" * 1200 + "…"), ("q2", "b" * 200)]))
def feedback_examples(spark, sf_dir):
    """Upvoted answers of 200 characters and more, long ones cut and marked."""
    rows = [("rating_up", "q1", "a" * 1200 + " " * 3 + "c"), ("rating_up", " q2 ", "b" * 200), ("rating_up", "q3", "short"), ("rating_down", "q4", "d" * 300), ("rating_up", " ", "e" * 300)]
    made = spark.createDataFrame(rows, "type string, q string, a string").select("type", F.struct(F.col("q").alias("query"), F.col("a").alias("assistant_message")).alias("context"))
    return feedback.examples(made)


@query(expected("alias, canonical", [("a", "A"), ("b", "B2"), ("c", "C")]))
def alias_upsert(spark, sf_dir):
    return feedback.listed_aliases(feedback.upserted_alias(spark.createDataFrame([("b", "B"), ("c", "C"), ("a", "A")], "alias string, canonical string"), " B ", "B2"))


_LOGGED = [(1, 2, "x" * 600, "y" * 1500, ["title"]), (2, 1, "", "", [])]


@query(expected("protocol_id, version, user_request, assistant_note, changed_fields", _LOGGED))
def change_log_entries(spark, sf_dir):
    rows = [(1, 2, "x" * 700, "y" * 1600, ["title"], "t"), (2, 1, None, None, None, "t")]
    return documents.change_log_entry(spark.createDataFrame(rows, "protocol_id int, version int, user_request string, assistant_note string, changed_fields array<string>, ts string")).drop("ts")


_META = [("p", "Phase II — TNBC — Drug", "Phase II", "triple negative", "d" * 200, "Drug (x)", "s" * 600, ["N1", "N2"]), ("q", "Untitled protocol", "", "", "", "", "", [])]


@query(expected("protocol_id, title, phase, conditions, study_design, intervention_name, summary_brief, source_ids", _META))
def protocol_metadata(spark, sf_dir):
    rows = [("p", None, " Phase II ", "triple negative", "d" * 300, "Drug (x)", "s" * 700, [" N1", "", "N2"]), ("q", None, None, None, None, None, None, None)]
    return documents.protocol_meta(spark.createDataFrame(rows, "protocol_id string, title string, phase string, conditions string, study_design string, intervention_name string, summary_brief string, source_ids array<string>"))


@query(expected("protocol_id, version", [("p", 3), ("new", 1)]))
def next_versions(spark, sf_dir):
    store = spark.createDataFrame([("u", "p", 1), ("u", "p", 2), ("v", "p", 7)], "user_id string, protocol_id string, version int")
    return versions.next_versions(store, spark.createDataFrame([("u", "p"), ("u", "new")], "user_id string, protocol_id string"), ["user_id", "protocol_id"]).select("protocol_id", "version")


@query(expected("corpus, display_name, trial_count, loaded", [(k, name, 2 if k == "melanoma" else 0, k == "melanoma") for k, name, _ in K.CORPORA]))
def corpora_loaded(spark, sf_dir):
    from spindrift.plans.engine import Engine

    return Engine.corpora(spark, spark.createDataFrame([("melanoma",), ("melanoma",)], "corpus string")).select("corpus", "display_name", F.coalesce("trial_count", F.lit(0)).alias("trial_count"), "loaded")


@query(expected("conv_id, turn, changed", [(1, 0, False), (1, 2, True), (1, 3, True)]))
def filters_that_change(spark, sf_dir):
    return conversation.changed_turns(filters_of_turns(spark, sf_dir), ["disease", "phase", "status"]).select("conv_id", "turn", "changed")


#: Documents of the search below; and the answers to each query of it.
_SEARCHES = [
    ("breast cancer in Japan", 5, ["N1"]), ("Merck breast cancer", 5, ["N2"]), ("breast cancer with a CDK4/6 inhibitor in the United Kingdom", 5, ["N2"]), ("breast cancer PARP inhibitor in Japan", 5, ["N1"]),
    ("breast cancer in Brazil", 5, ["N1", "N2"]), ("breast cancer", 1, None), ("observational breast cancer", 5, ["N2"]),
]


@query(expected("query, k, ids", [(q, k, i) for q, k, i in _SEARCHES if i]))
def filtered_search(spark, sf_dir):
    """Search with structured filters: classes all, else any, else the other filters alone; the pool if those leave nothing."""
    from spindrift.plans.engine import Engine

    engine = Engine(_documents(spark))
    found = [engine.search(q, k).agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).select(F.lit(q).alias("query"), F.lit(k).alias("k"), "ids") for q, k, i in _SEARCHES if i]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out
