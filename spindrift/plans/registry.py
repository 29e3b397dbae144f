"""Registered queries over one trial-shaped view of the given tables, whole.

A document is a study: its text the summary, a part what is tried, a supplier the sponsor, a nation the place; what these tables lack (status, phase,
drug, condition) follows from the document's number. The view is made as nested JSON, as a registry lands it, and
parsed, built into documents, indexed and searched by the library's own operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import documents, landscape, retrieval, search
from ..sources import trials
from .catalog import _VOTES_SQL, NOW, _votes, query, table

STATUS = ["RECRUITING", "COMPLETED", "NOT_YET_RECRUITING"]
TYPES = ["INTERVENTIONAL", "OBSERVATIONAL"]
PHASE_LISTS = [["PHASE1"], ["PHASE2"], ["PHASE1", "PHASE2"], []]
CONDITIONS = ["Triple-Negative Breast Cancer", "Metastatic Breast Cancer", "Early HER2-positive Breast Cancer", "Neoadjuvant Treatment of Lymphoma"]
DRUGS = ["Palbociclib", "Olaparib", "Paclitaxel", "Carboplatin", "Pembrolizumab", "Aspirin", "Trastuzumab deruxtecan"]
LANDS = ["United States", "Japan", "France", "Germany", "Brazil"]
SPONSORS = ["Pfizer Inc", "Merck Sharp & Dohme", "Novartis Pharmaceuticals", "City Hospital"]
DRUG_CLASSES = {
    "Palbociclib": ["CDK4/6 inhibitor"], "Olaparib": ["PARP inhibitor"], "Paclitaxel": ["Taxane chemotherapy"], "Carboplatin": ["Platinum chemotherapy"],
    "Pembrolizumab": ["PD-(L)1 / immune checkpoint"], "Aspirin": [], "Trastuzumab deruxtecan": ["ADC (antibody-drug conjugate)", "HER2-targeted therapy"],
}


def _pick(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _listed(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_listed, value)) + "]" + ("" if value else "::VARCHAR[]")
    return "'" + str(value).replace("'", "''") + "'"


def _pick_sql(values: list, key: str) -> str:
    return f"{_listed(values)}[CAST({key} AS BIGINT) % {len(values)} + 1]"


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: one study a line, as JSON."""
    d = table(spark, sf_dir, "documents").withColumn("supplier", (F.col("doc_id") % 10).cast("long"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), "s_name", "s_nationkey", "n_name")
    # all documents have a few suppliers: those go to the documents, whose texts would meet in as many tasks
    few = F.broadcast(supplier.filter(F.col("supplier").between(-9, 9)))
    rows = d.join(part, "doc_id", "left").join(few, "supplier", "left")
    k, land = F.col("doc_id"), F.coalesce("s_nationkey", F.lit(0))
    condition = _pick(CONDITIONS, F.floor(k / 2))
    first = _pick(LANDS, land)
    site = lambda country: F.struct(F.col("s_name").alias("facility"), F.lit("RECRUITING").alias("status"), F.col("n_name").alias("city"), F.when(country == "United States", _pick(["Texas", "Ohio"], k)).alias("state"), country.alias("country"))
    chair = F.struct(F.concat(F.lit("Dr "), "s_name").alias("name"), F.lit("STUDY_CHAIR").alias("role"), F.lit(None).cast("string").alias("affiliation"))
    lead = F.struct(F.concat(F.lit("Prof "), "n_name").alias("name"), F.lit("PRINCIPAL_INVESTIGATOR").alias("role"), F.col("n_name").alias("affiliation"))
    drug = lambda name: F.struct(name.alias("name"), F.lit("DRUG").alias("type"))
    criteria = F.concat(F.lit("Inclusion Criteria: adults with "), condition, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" Exclusion Criteria: "), F.coalesce("p_type", F.lit("none")))))
    section = F.struct(
        F.struct(F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0")).alias("nctId"), F.concat(F.coalesce("p_name", F.lit("part")), F.lit(" for "), condition).alias("briefTitle")).alias("identificationModule"),
        F.struct(_pick(STATUS, k).alias("overallStatus")).alias("statusModule"),
        F.struct(F.col("text").alias("briefSummary")).alias("descriptionModule"),
        F.struct(F.array(condition).alias("conditions")).alias("conditionsModule"),
        F.struct(_pick(TYPES, F.floor(k / 3)).alias("studyType"), _pick(PHASE_LISTS, k).alias("phases"), F.struct(F.col("n_chars").cast("int").alias("count")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(criteria.alias("eligibilityCriteria"), (k % 2 == 0).alias("healthyVolunteers")).alias("eligibilityModule"),
        F.struct(F.when(k % 2 == 0, F.array(chair, lead)).otherwise(F.array(chair)).alias("overallOfficials"), F.when(k % 3 == 0, F.array(site(first), site(_pick(LANDS, land + 1)))).otherwise(F.array(site(first))).alias("locations")).alias("contactsLocationsModule"),
        F.struct(F.when(k % 5 == 0, F.array(drug(_pick(DRUGS, k)), drug(F.lit("Carboplatin")))).otherwise(F.array(drug(_pick(DRUGS, k)))).alias("interventions"),
                 F.array(F.struct(F.col("p_brand").alias("label"), F.lit("EXPERIMENTAL").alias("type"), F.col("p_name").alias("description"))).alias("armGroups")).alias("armsInterventionsModule"),
        F.struct(F.struct(F.concat(_pick(SPONSORS, F.col("supplier")), F.lit(" "), F.coalesce("s_name", F.lit("unknown"))).alias("name"), F.when(F.col("supplier") % 4 < 3, "INDUSTRY").otherwise("OTHER").alias("class")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
    )
    return rows.select(F.to_json(F.struct(section.alias("protocolSection"))).alias("value"))


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = studies(spark, sf_dir).select(F.from_json("value", trials.STUDY).alias("s")).select("s.*")
    return trials.parse_studies(parsed)


def trial_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.build_documents(trial_rows(spark, sf_dir))


_DRUG_SQL = _pick_sql(DRUGS, "d.doc_id")
_CLASS_SQL = "MAP {" + ", ".join(f"{_listed(k)}: {_listed(v)}" for k, v in DRUG_CLASSES.items()) + "}"
_ORDER_SQL = _listed([name for name, _ in K.CLASS_PATTERNS])
#: The view by joins and lists, without JSON.
TRIALS_SQL = f"""
base AS (
  SELECT d.doc_id, d.text, d.n_chars, p_name, p_brand, p_type, s_name, n_name, d.doc_id % 10 AS supplier, coalesce(s_nationkey, 0) AS land, {_pick_sql(CONDITIONS, "d.doc_id // 2")} AS condition,
    CASE WHEN d.doc_id % 5 = 0 THEN [{_DRUG_SQL}, 'Carboplatin'] ELSE [{_DRUG_SQL}] END AS drugs
  FROM documents d LEFT JOIN part ON p_partkey = d.doc_id LEFT JOIN supplier ON s_suppkey = d.doc_id % 10 LEFT JOIN nation ON n_nationkey = s_nationkey
), lands AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN [{_pick_sql(LANDS, "land")}, {_pick_sql(LANDS, "land + 1")}] ELSE [{_pick_sql(LANDS, "land")}] END AS countries FROM base
), t AS (
  SELECT 'NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS nct, doc_id AS n, coalesce(p_name, 'part') || ' for ' || condition AS title, {_pick_sql(STATUS, "doc_id")} AS status, coalesce(text, '') AS summary, condition,
    {_pick_sql(TYPES, "doc_id // 3")} AS study_type, array_to_string({_pick_sql(PHASE_LISTS, "doc_id")}, ', ') AS phases, CAST(n_chars AS INTEGER) AS enrollment,
    'Inclusion Criteria: adults with ' || condition AS including, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Exclusion Criteria: ' || coalesce(p_type, 'none') END AS excluding,
    coalesce(CASE WHEN doc_id % 2 = 0 THEN 'Prof ' || n_name ELSE 'Dr ' || s_name END, '') AS pi, CASE WHEN doc_id % 2 = 0 THEN coalesce(n_name, '') ELSE '' END AS pi_affiliation,
    array_to_string(drugs, ', ') AS intervention, array_to_string(list_transform(drugs, lambda x: 'DRUG'), ', ') AS kinds, coalesce(p_brand, '') || ': EXPERIMENTAL - ' || coalesce(p_name, '') AS arms,
    {_pick_sql(SPONSORS, "supplier")} || ' ' || coalesce(s_name, 'unknown') AS sponsor, CASE WHEN supplier % 4 < 3 THEN 'INDUSTRY' ELSE 'OTHER' END AS sponsor_class, len(countries) AS location_count,
    array_to_string(list_sort(list_distinct(countries)), ', ') AS countries,
    array_to_string(list_transform(countries, lambda c: coalesce(s_name, 'N/A') || ' (RECRUITING) - ' || coalesce(n_name, 'N/A') || ', ' || CASE WHEN c = 'United States' THEN {_pick_sql(["Texas", "Ohio"], "doc_id")} ELSE 'N/A' END || ', ' || c), ', ') AS locations,
    list_filter({_ORDER_SQL}, lambda x: list_contains(flatten(list_transform(drugs, lambda d: {_CLASS_SQL}[d])), x)) AS classes
  FROM lands
)"""

_PARTS_SQL = [("Title", "title"), ("Summary", r"regexp_replace(summary, '^\s+|\s+$', '', 'g')"), ("Conditions", "condition"), ("Intervention", "intervention"), ("Intervention Type", "kinds"), ("Arm Groups", "arms"),
    ("Inclusion Criteria", "including"), ("Exclusion Criteria", "excluding"), ("Phase", "phases"), ("Status", "status"), ("Study Type", "study_type"), ("Sponsor", "sponsor"), ("Principal Investigator", "pi"),
    ("PI Affiliation", "pi_affiliation"), ("Location", "locations"), ("Countries", "countries")]
_TEXT_SQL = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {c} <> '' THEN '{label}: ' || {c} END" for label, c in _PARTS_SQL) + ")"


@query(f"""WITH {TRIALS_SQL} SELECT nct AS "nctId", title AS "bTitle", sponsor AS "sponsorName", sponsor_class AS "sponsorClass", status AS "oStatus", length(summary) AS n_summary, condition AS conditions, study_type AS "studyType", phases,
coalesce(enrollment, 0) AS "enrollmentCont", intervention AS "interventionName", kinds AS "interventionType", arms AS "armGroups", including AS "includeCriteria", excluding AS "excludeCriteria", pi AS "piName", pi_affiliation AS "piAffiliation",
countries AS "locationCountries", CAST(location_count AS INTEGER) AS "locationCount", locations AS "locationInfo", CASE WHEN n % 2 = 0 THEN 'True' ELSE 'False' END AS "healthyVolunteers", 'ALL' AS sex, '' AS acronym FROM t""")
def registry_studies(spark, sf_dir):
    """Nested studies of all documents, parsed to flat rows."""
    return trial_rows(spark, sf_dir).select(
        "nctId", "bTitle", "sponsorName", "sponsorClass", "oStatus", F.char_length("summary").cast("long").alias("n_summary"), "conditions", "studyType", "phases", "enrollmentCont", "interventionName", "interventionType",
        "armGroups", "includeCriteria", "excludeCriteria", "piName", "piAffiliation", "locationCountries", "locationCount", "locationInfo", "healthyVolunteers", "sex", "acronym",
    )


@query(f"""WITH {TRIALS_SQL} SELECT nct AS doc_id, substr(sha256({_TEXT_SQL}), 1, 16) AS text_hash, title, phases, status, coalesce(enrollment, 0) AS enrollment, substr(locations, 1, 500) AS locations, classes AS drug_classes,
contains(countries, 'Japan') AS in_japan, contains(locations, 'Texas') AS in_texas, study_type = 'OBSERVATIONAL' AS observational, status = 'RECRUITING' AS recruiting, contains(sponsor, 'Merck') AS by_merck,
condition LIKE 'Metastatic%' AS metastatic, condition NOT LIKE 'Metastatic%' AS early, condition LIKE 'Neoadjuvant%' AS neoadjuvant, phases = 'PHASE2' AS second_phase, list_contains(classes, 'CDK4/6 inhibitor') AS cdk,
list_contains(classes, 'CDK4/6 inhibitor') OR list_contains(classes, 'ADC (antibody-drug conjugate)') AS cdk_or_adc, list_has_all(classes, ['PARP inhibitor', 'Platinum chemotherapy']) AS parp_and_platinum FROM t""")
def trial_documents(spark, sf_dir):
    """Documents built of all studies, their classes, and what each filter of a query keeps."""
    own, places, setting = F.col("drug_classes"), F.coalesce(X.or_null(F.col("locationInfoFull")), F.col("locationInfo")), documents.setting_text()
    return trial_docs(spark, sf_dir).select(
        "doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"), "title", "phases", "status", F.col("enrollmentCont").alias("enrollment"), F.col("locationInfo").alias("locations"), "drug_classes",
        X.holds_any(F.col("locationCountries"), ["Japan"]).alias("in_japan"), X.holds_any(places, ["Texas"]).alias("in_texas"), (F.upper("studyType") == "OBSERVATIONAL").alias("observational"),
        F.upper("status").isin("RECRUITING").alias("recruiting"), X.holds_any(F.col("sponsorName"), ["merck"]).alias("by_merck"), X.matches_setting(setting, "metastatic").alias("metastatic"),
        X.matches_setting(setting, "adjuvant").alias("early"), X.matches_setting(setting, "neoadjuvant").alias("neoadjuvant"), (X.cleaned(F.col("phases")) == "PHASE2").alias("second_phase"),
        X.has_all(own, ["CDK4/6 inhibitor"]).alias("cdk"), X.has_any(own, ["CDK4/6 inhibitor", "ADC (antibody-drug conjugate)"]).alias("cdk_or_adc"), X.has_all(own, ["PARP inhibitor", "Platinum chemotherapy"]).alias("parp_and_platinum"),
    )


@query(f"""WITH {TRIALS_SQL} SELECT nct AS nct_id, title, 0.5::DOUBLE AS score, phases, status, study_type, condition AS conditions, intervention, kinds AS intervention_type, CAST(coalesce(enrollment, 0) AS VARCHAR) AS enrollment, 'ALL' AS sex, sponsor, sponsor_class,
pi AS pi_name, pi_affiliation, substr(locations, 1, 500) AS location, countries AS location_countries, CAST(location_count AS INTEGER) AS location_count, '' AS contact, 31 AS n_fields FROM t""")
def source_cards(spark, sf_dir):
    """The card of every document."""
    card = documents.source_card(trial_docs(spark, sf_dir).withColumn("nctId", F.col("doc_id")).withColumn("score", F.lit(0.5)))
    shown = "nct_id title score phases status study_type conditions intervention intervention_type enrollment sex sponsor sponsor_class pi_name pi_affiliation location location_countries location_count contact".split()
    return card.select(*shown, F.lit(len(card.columns)).alias("n_fields"))


#: What is asked, with what it asks for: countries, states, setting, study type, statuses, sponsors, classes, population, phase, one status, an earlier protocol.
ASKED = [
    ("trials in Japan, phase 2", ["Japan"], [], None, None, [], [], [], None, "PHASE2", None, False),
    ("Merck studies, completed", [], [], None, None, ["COMPLETED"], ["merck"], [], None, None, "COMPLETED", False),
    ("observational studies of neoadjuvant therapy", [], [], "neoadjuvant", "OBSERVATIONAL", [], [], [], None, None, None, False),
    ("PARP inhibitor with platinum chemotherapy in TNBC", [], [], None, None, [], [], ["Platinum chemotherapy", "PARP inhibitor"], "Triple-Negative Breast Cancer (TNBC)", None, None, False),
    ("recruiting in Texas", [], ["Texas"], None, None, ["RECRUITING"], [], [], None, None, "RECRUITING", False),
    ("", [], [], None, None, [], [], [], None, None, None, False),
    ("taxane for Mexican sites", ["Mexico"], [], None, None, [], [], ["Taxane chemotherapy"], None, None, None, False),
    ("metastatic disease, based on my previous protocol", [], [], "metastatic", None, [], [], [], None, None, None, True),
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, text: every benchmark text with something asked in front."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("qid"), F.concat(_pick([a[0] for a in ASKED], F.col("item_id")), F.lit(" "), "text").alias("text"))


def _asked_sql(i: int, kind: str) -> str:
    values = ["NULL" if a[i] is None else str(a[i]).lower() if isinstance(a[i], bool) else _listed(a[i]) for a in ASKED]
    return f"CAST([{', '.join(values)}][item_id % {len(ASKED)} + 1] AS {kind})"


_INTENTS = [("countries", "VARCHAR[]"), ("states", "VARCHAR[]"), ("setting", "VARCHAR"), ("study_type", "VARCHAR"), ("statuses", "VARCHAR[]"), ("sponsors", "VARCHAR[]"), ("classes", "VARCHAR[]"), ("disease", "VARCHAR"), ("phase", "VARCHAR"), ("status", "VARCHAR"), ("earlier", "BOOLEAN")]
_ASKED_SQL = "SELECT item_id AS qid, " + ", ".join(f"{_asked_sql(i, kind)} AS {c}" for i, (c, kind) in enumerate(_INTENTS, 1)) + " FROM benchmark"


@query(_ASKED_SQL)
def query_intents(spark, sf_dir):
    """What every question asks for, read from its text."""
    t = F.col("text")
    asked = search.wanted(questions(spark, sf_dir))
    return asked.select("qid", *search.WANTED, X.disease(t).alias("disease"), X.phase(t).alias("phase"), X.one_status(t).alias("status"), X.asks_for_earlier_protocol(t).alias("earlier"))


#: Words that are too common to tell documents apart.
STOP_WORDS = ["the", "and", "of", "in", "la", "le", "les", "der", "die", "das", "que", "el", "un", "une", "for", "with"]
MOST_TERMS = 10_000


def trial_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, retrieval.Index]:
    from ..sources.files import staged

    docs = staged(trial_docs(spark, sf_dir), "trial-documents")
    return docs, retrieval.indexed(docs, "doc_id", "text", MOST_TERMS, stop_words=STOP_WORDS, bigrams=True)


def _grams_sql(text: str) -> str:
    words = rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_listed(STOP_WORDS)}, w))"
    return f"(SELECT list_concat(l, list_transform(range(1, len(l)), lambda i: l[CAST(i AS INT)] || ' ' || l[CAST(i + 1 AS INT)])) FROM (SELECT {words} AS l))"


_DRUG_NAMES_SQL = "MAP {" + ", ".join(f"{_listed(k)}: {_listed(list(v))}" for k, v in K.CLASS_DRUGS.items()) + "}"
_SEARCH_SQL = f"""{TRIALS_SQL},
docs AS (SELECT *, {_TEXT_SQL} AS text FROM t),
tf AS (SELECT nct, term, count(*) AS tf FROM (SELECT nct, unnest({_grams_sql("text")}) AS term FROM docs) GROUP BY 1, 2),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf, sum(tf) AS cf FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT {MOST_TERMS}),
dr AS (SELECT nct, term, (1 + ln(tf)) * idf AS w FROM tf JOIN v USING (term)), dn AS (SELECT nct, sqrt(sum(w * w)) AS norm FROM dr GROUP BY 1),
want AS ({_ASKED_SQL}),
said AS (SELECT item_id AS qid, {_listed([a[0] for a in ASKED])}[item_id % {len(ASKED)} + 1] || ' ' || text AS text FROM benchmark),
named AS (SELECT qid, said.text, list_distinct(flatten(list_transform(classes, lambda c: {_DRUG_NAMES_SQL}[c]))) AS drugs FROM said JOIN want USING (qid)),
wide AS (SELECT qid, text || coalesce(' ' || nullif(array_to_string(list_filter(drugs, lambda d: NOT contains(lower(text), lower(d))), ' '), ''), '') AS text FROM named),
qtf AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_grams_sql("text")}) AS term FROM wide) GROUP BY 1, 2),
qr AS (SELECT qid, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN v USING (term)), qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qr GROUP BY 1),
sc AS (SELECT qid, nct, round(sum(qr.w / qn.norm * dr.w / dn.norm), 6) AS score FROM qr JOIN qn USING (qid) JOIN dr USING (term) JOIN dn USING (nct) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, nct) AS rank FROM sc WHERE score > 0),
sz AS (SELECT *, study_type IS NOT NULL OR len(statuses) > 0 OR len(sponsors) > 0 OR len(classes) > 0 AS attr, len(countries) > 0 OR len(states) > 0 OR setting IS NOT NULL AS other FROM want),
pool AS (SELECT rk.*, w.countries AS w_countries, w.states, w.setting, w.study_type AS w_type, w.statuses, w.sponsors, w.classes AS w_classes, d.* EXCLUDE (nct)
  FROM rk JOIN sz w USING (qid) JOIN docs d USING (nct) WHERE rank <= CASE WHEN attr THEN 200 WHEN other THEN 50 ELSE 5 END),
met AS (SELECT *, (len(w_countries) = 0 OR len(list_filter(w_countries, lambda c: contains(lower(countries), lower(c)))) > 0) AND (len(states) = 0 OR len(list_filter(states, lambda s: contains(lower(locations), lower(s)))) > 0)
    AND (setting IS NULL OR CASE setting WHEN 'metastatic' THEN condition LIKE 'Metastatic%' WHEN 'neoadjuvant' THEN condition LIKE 'Neoadjuvant%' ELSE condition NOT LIKE 'Metastatic%' END)
    AND (w_type IS NULL OR study_type = w_type) AND (len(statuses) = 0 OR list_contains(statuses, status)) AND (len(sponsors) = 0 OR len(list_filter(sponsors, lambda s: contains(lower(sponsor), s))) > 0) AS own FROM pool),
step AS (SELECT *, own AND len(w_classes) > 0 AND list_has_all(classes, w_classes) AS m1, own AND len(w_classes) > 0 AND list_has_any(classes, w_classes) AS m2 FROM met),
flag AS (SELECT *, max(m1) OVER w AS a1, max(m2) OVER w AS a2, max(own) OVER w AS a3 FROM step WINDOW w AS (PARTITION BY qid)),
kept AS (SELECT * FROM flag WHERE CASE WHEN a1 THEN m1 WHEN a2 THEN m2 WHEN a3 THEN own ELSE true END)"""


@query(f"""WITH {_SEARCH_SQL}, place AS (SELECT qid, nct AS doc_id, score, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM kept)
SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM place WHERE place <= 5""")
def filtered_retrieve(spark, sf_dir):
    """All questions searched as one batch over the sparse index as the application fits it: bigrams, stop words, the 10,000 most frequent terms."""
    docs, index = trial_index(spark, sf_dir)
    return search.retrieved(questions(spark, sf_dir), docs, index).select("qid", "doc_id", "score", "rank", "place")


def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions() with the population, phase and status known so far."""
    k = F.col("qid")
    return questions(spark, sf_dir).select(
        "qid", "text", _pick(["Triple-Negative Breast Cancer (TNBC)", "HER2+ Breast Cancer", ""], k).alias("disease"), F.nullif(_pick(["PHASE1", "PHASE2", "", "PHASE4"], k), F.lit("")).alias("phase"), F.when(k % 5 == 0, "RECRUITING").alias("status")
    )


@query()
def chat_retrieve(spark, sf_dir):
    """The documents of a chat turn for every question, feedback included. The spread over classes takes turns, so there is no SQL; tests hold it against plain Python."""
    from ..operators import feedback

    docs, index = trial_index(spark, sf_dir)
    net = feedback.source_scores(_votes(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    scores = net.select(F.concat(F.lit("NCT"), F.lpad("doc_id", 8, "0")).alias("doc_id"), "net")
    return search.chat(chat_questions(spark, sf_dir), docs, index, scores).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank", "place")


@query(f"""WITH {TRIALS_SQL}, p AS (SELECT * FROM t WHERE regexp_matches(lower(title || ' || ' || condition), 'triple[\\s\\-]*negative')),
o AS (SELECT * FROM p WHERE status = 'RECRUITING'),
s AS (SELECT 'phase' AS section, coalesce(nullif(phases, ''), '(unspecified)') AS label FROM o UNION ALL SELECT 'status', status FROM o UNION ALL SELECT 'sponsor_class', sponsor_class FROM o
  UNION ALL SELECT 'intervention_type', unnest(string_split(kinds, ', ')) FROM o UNION ALL SELECT 'drug_class', unnest(classes) FROM o UNION ALL SELECT 'geography', unnest(string_split(countries, ', ')) FROM o),
c AS (SELECT section, label, count(*) AS count FROM s GROUP BY 1, 2)
SELECT 'totals' AS section, 'population_total' AS label, count(*) AS count FROM p UNION ALL SELECT 'totals', 'total', count(*) FROM o UNION ALL SELECT * FROM c""")
def trial_landscape(spark, sf_dir):
    """Totals and distributions of one population's recruiting trials."""
    return landscape.landscape(trial_docs(spark, sf_dir), dict(K.DISEASES)["Triple-Negative Breast Cancer (TNBC)"].split("|")[0], None, "RECRUITING").select("section", "label", "count")


@query("SELECT c.corpus, coalesce(n, 0) AS trial_count, coalesce(n, 0) > 0 AS loaded FROM (SELECT unnest(" + _listed([c for c, _, _ in K.CORPORA]) + ") AS corpus) c LEFT JOIN (SELECT " + _pick_sql([c for c, _, _ in K.CORPORA[:9]], "doc_id") + " AS corpus, count(*) AS n FROM documents GROUP BY 1) USING (corpus)")
def corpora_loaded(spark, sf_dir):
    """Every known corpus with its documents, some of them without any."""
    from .engine import Engine

    docs = table(spark, sf_dir, "documents").select(_pick([c for c, _, _ in K.CORPORA[:9]], F.col("doc_id")).alias("corpus"))
    return Engine.corpora(spark, docs).select("corpus", F.coalesce("trial_count", F.lit(0)).alias("trial_count"), "loaded")


@query(f"""WITH {_SEARCH_SQL}, place AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM kept)
SELECT qid, string_agg('<trial id=' || CAST(place AS VARCHAR) || '>' || chr(10) || 'NCT ID: ' || nct || chr(10) || 'Title: ' || title || CASE WHEN phases <> '' THEN chr(10) || 'Phase: ' || phases ELSE '' END || chr(10) || 'Status: ' || status ||
  CASE WHEN coalesce(enrollment, 0) <> 0 THEN chr(10) || 'Enrollment: ' || CAST(enrollment AS VARCHAR) ELSE '' END || chr(10) || '</trial>', chr(10) || chr(10) ORDER BY place) AS context FROM place WHERE place <= 5 GROUP BY 1""")
def answer_contexts(spark, sf_dir):
    """What an answer to each question would be told: the documents found, as numbered blocks."""
    from ..operators import documents as d

    docs, index = trial_index(spark, sf_dir)
    found = search.retrieved(questions(spark, sf_dir), docs, index)
    return d.context(found, {"title": "Title", "phases": "Phase", "status": "Status", "enrollmentCont": "Enrollment"}, rank="place", by="qid")


@query("SELECT CAST(count(*) AS BIGINT) AS trials, 9 AS loaded, 13 AS known FROM documents")
def corpus_health(spark, sf_dir):
    """Trials of all loaded corpora; every document's corpus is among them, or this is an error."""
    from .engine import Engine

    docs = table(spark, sf_dir, "documents").select(_pick([c for c, _, _ in K.CORPORA[:9]], F.col("doc_id")).alias("corpus"))
    corpora = Engine.corpora(spark, docs)
    Engine.of_enabled(docs, corpora)
    return Engine.health(corpora)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id >= (SELECT max(doc_id) * 3 // 4 FROM documents) AND lang IN ('en', 'de') AND source IS NOT NULL")
def registry_pages(spark, sf_dir):
    """Documents landed as pages and read back with filters that skip pages."""
    import uuid

    from ..sources import pages
    from ..sources.files import shared_folder

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    path = shared_folder(spark, f"pages-{uuid.uuid4().hex}")
    pages.land(docs, path, ["doc_id"], 50)
    least = docs.agg(F.max("doc_id")).head()[0] * 3 // 4
    return pages.read(spark, path, "doc_id long, lang string, source string, n_chars long").filter(F.col("doc_id") >= least).filter(F.col("lang").isin("en", "de") & F.col("source").isNotNull())
