import pytest
from pyspark.sql import functions as F

from spindrift.functions import constants as K
from spindrift.functions import text as X


def value(spark, make, *texts):
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).head()["v"]


@pytest.mark.parametrize(
    "make, text, want",
    [
        (X.sponsors, "Show me AstraZeneca's ADC trials", ["astrazeneca"]),
        (X.sponsors, "MSD-sponsored studies", ["merck"]),
        (X.sponsors, "J&J pipeline trials", ["janssen"]),
        (X.sponsors, "Bristol Myers Squibb trials", ["bristol"]),
        (X.sponsors, "Hoffmann-La Roche and Roche", ["roche"]),
        (X.drug_classes_named, "ADC + checkpoint inhibitor combinations in TNBC", ["PD-(L)1 / immune checkpoint", "ADC (antibody-drug conjugate)"]),
        (X.drug_classes_named, "anti-PD-1 monotherapy", ["PD-(L)1 / immune checkpoint"]),
        (X.drug_classes_named, "CDK4/6 inhibitor in HR+", ["CDK4/6 inhibitor"]),
        (X.drug_classes_named, "advanced metastatic breast cancer", []),
        (X.countries, "trials in the United States", ["United States"]),
        (X.countries, "show us trials", ["United States"]),
        (X.countries, "U.S. trials", []),
        (X.states, "West Virginia", ["West Virginia"]),
        (X.statuses, "not yet recruiting or completed", ["NOT_YET_RECRUITING", "COMPLETED"]),
        (X.statuses, "enrolling by invitation", ["ENROLLING_BY_INVITATION"]),
        (X.one_status, "enrolling by invitation", "RECRUITING"),
        (X.study_type, "expanded access programmes", "EXPANDED_ACCESS"),
        (X.phase, "phase 1b", None),
        (X.phase, "phase 1/2", "PHASE1"),
        (X.phase, "Phase III", "PHASE3"),
        (X.phase, "early phase 1", "EARLY_PHASE1"),
        (X.disease, "triple-negative disease", "Triple-Negative Breast Cancer (TNBC)"),
        (X.setting_intent, "neoadjuvant therapy", "neoadjuvant"),
        (X.setting_intent, "adjuvant therapy", "adjuvant"),
        (X.setting_intent, "stage IV", "metastatic"),
        (X.asks_for_earlier_protocol, "Edit my last draft", True),
        (X.confirms, "Yes, please update!", True),
        (X.confirms, "apply items 1, 2 and 3", True),
        (X.confirms, "what does it say?", False),
        (X.ids_named, "NCT00000001, NCT123 and NCT00000002.", ["NCT00000001", "NCT00000002"]),
        (X.user_key, " a/b c ", "a_b_c"),
        (X.user_key, "  ", "anonymous"),
        (X.countries, None, []),
    ],
)
def test_extractors(spark, make, text, want):
    assert value(spark, make, text) == want


def test_sizes_of_tables():
    assert [len(t) for t in (K.COUNTRIES, K.STATES, K.SPONSORS, K.CLASS_WORDS, K.CLASS_PATTERNS, K.DISEASES, K.STATUSES, K.SHORT_POPULATIONS, K.EARLIER_PROTOCOL, K.DIFF_FIELDS)] == [
        43, 53, 32, 46, 17, 9, 9, 11, 18, 34,
    ]


def test_titles(spark):
    title = lambda *a: value(spark, X.protocol_title, *a)
    assert title("Phase II", "TNBC triple negative", "Trastuzumab deruxtecan (T-DXd)", "x") == "Phase II — TNBC — Trastuzumab deruxtecan"
    assert title("N/A", None, None, "x").startswith("RWE")
    assert title(None, None, None, "A title") == "A title"
    assert title(None, None, None, None) == "Untitled protocol"


def test_criteria(spark):
    parts = lambda t: [value(spark, lambda c, i=i: X.criteria(c)[i], t) for i in (0, 1)]
    assert parts("Inclusion Criteria: a\nExclusion Criteria: b") == ["Inclusion Criteria: a", "Exclusion Criteria: b"]
    assert parts("x Exclusion Criteria: b") == ["x", "Exclusion Criteria: b"]
    assert parts("Exclusion Criteria: b Inclusion Criteria: a") == ["", "Exclusion Criteria: b Inclusion Criteria: a"]
    assert parts("only") == ["only", ""]
    assert parts(None) == ["", ""]


def test_classes_and_expansion(spark):
    both = value(spark, X.drug_classes, "Datopotamab deruxtecan", "Durvalumab")
    wanted = ["ADC (antibody-drug conjugate)", "PD-(L)1 / immune checkpoint"]
    assert set(both) == set(wanted)
    assert value(spark, lambda a, b: X.has_all(X.drug_classes(a, b), wanted), "Sacituzumab govitecan", None) is False
    assert value(spark, lambda a, b: X.has_any(X.drug_classes(a, b), wanted), "Sacituzumab govitecan", None) is True
    widened = value(spark, lambda c: X.with_drugs(c, X.drug_classes_named(c)), "PARP inhibitor with olaparib")
    assert widened == "PARP inhibitor with olaparib Talazoparib Niraparib"


def test_week_change(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (3, 2), (1, 2)], "a long, b long")
    assert [r[0] for r in df.select(X.week_change(F.col("a"), F.col("b"))).collect()] == ["—", "(new)", "+50.0%", "−50.0%"]


def test_matches_setting(spark):
    for text, want in (("non-metastatic", (True, False, True)), ("neoadjuvant", (False, True, True)), ("advanced", (True, False, False)), ("", (False, False, True))):
        assert tuple(value(spark, lambda c, s=s: X.matches_setting(c, s), text) for s in ("metastatic", "neoadjuvant", "adjuvant")) == want
