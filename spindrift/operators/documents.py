"""Documents from trial rows: labelled text, metadata, source cards, prompt context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X

# Metadata names that differ from the trial columns', and lengths of those that are cut for display.
RENAMED = {"bTitle": "title", "oTitle": "officialTitle", "oStatus": "status"}
CUT = {"armGroups": 500, "primaryOutcomes": 500, "secondaryOutcomes": 500, "locationInfo": 500, "contactInfo": 300}
METADATA = [
    "nctId", "bTitle", "oTitle", "acronym", "phases", "oStatus", "studyType", "startDate", "primaryCompletionDate", "completionETA", "lastUpdateDate",
    "conditions", "keywords", "meshTermsCondition", "allocation", "interventionModel", "primaryPurpose", "masking", "enrollmentCont", "enrollmentType",
    "interventionName", "interventionType", "interventionOtherNames", "armGroups", "sex", "minimumAge", "maximumAge", "healthyVolunteers", "primaryOutcomes",
    "secondaryOutcomes", "sponsorName", "sponsorClass", "piName", "piAffiliation", "locationInfo", "locationCountries", "locationCount", "contactInfo",
    "isFdaRegulatedDrug",
]


# Fixed values. Fields of a result's card, in order, with the document columns that they show.
CARD = {
    "nct_id": "nctId", "title": "title", "score": "score", "phases": "phases", "status": "status", "study_type": "studyType", "allocation": "allocation",
    "masking": "masking", "primary_purpose": "primaryPurpose", "conditions": "conditions", "keywords": "keywords", "intervention": "interventionName",
    "intervention_type": "interventionType", "drug_aliases": "interventionOtherNames", "enrollment": "enrollmentCont", "enrollment_type": "enrollmentType", "sex": "sex",
    "minimum_age": "minimumAge", "maximum_age": "maximumAge", "primary_outcomes": "primaryOutcomes", "sponsor": "sponsorName", "sponsor_class": "sponsorClass",
    "pi_name": "piName", "pi_affiliation": "piAffiliation", "start_date": "startDate", "completion_date": "completionETA", "last_updated": "lastUpdateDate",
    "location": "locationInfo", "location_countries": "locationCountries", "location_count": "locationCount", "contact": "contactInfo",
}


def labelled_text(pairs: list[tuple[str, str]]):
    """Lines "Label: value" of the columns that have a value."""
    return F.concat_ws("\n", *[F.when(X.cleaned(F.col(c)) != "", F.concat(F.lit(f"{label}: "), X.cleaned(F.col(c)))) for label, c in pairs])


def build_documents(trials: DataFrame) -> DataFrame:
    """doc_id, text, metadata columns, and drug_classes, which is classified once here."""
    counts = ("enrollmentCont", "locationCount")
    meta = [
        F.coalesce(F.col(c), F.lit(0)).alias(c) if c in counts
        else (F.substring(X.cleaned(F.col(c)), 1, CUT[c]) if c in CUT else X.cleaned(F.col(c))).alias(RENAMED.get(c, c))
        for c in METADATA
    ]
    return trials.select(
        X.cleaned(F.col("nctId")).alias("doc_id"), labelled_text(K.TEXT_LABELS).alias("text"), *meta, X.cleaned(F.col("locationInfo")).alias("locationInfoFull"),
        X.drug_classes(F.col("interventionName"), F.col("interventionOtherNames")).alias("drug_classes"),
    )


def population_text():
    """What population filters read: titles and condition terms, never summary or criteria."""
    return F.concat_ws(" || ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "officialTitle", "conditions", "keywords", "meshTermsCondition")])


def setting_text():
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "officialTitle", "conditions", "keywords")])


def source_card(ranked: DataFrame) -> DataFrame:
    """What a result's card shows of build_documents() with a score: texts are empty and counts 0 where there is no value."""
    shown = {c: F.coalesce(F.col(m).cast("string"), F.lit("")) for c, m in CARD.items()} | {"score": F.col("score"), "location_count": F.coalesce("locationCount", F.lit(0))}
    return ranked.select(*[shown[c].alias(c) for c in CARD])


def protocol_meta(rows: DataFrame) -> DataFrame:
    """protocol_id and a protocol's derived fields, trimmed and cut for a list."""
    cut = lambda c, n: F.substring(X.cleaned(F.col(c)), 1, n).alias(c)
    title = X.protocol_title(F.col("phase"), F.col("conditions"), F.col("intervention_name"), F.col("title"))
    return rows.select(
        "protocol_id", title.alias("title"), X.cleaned(F.col("phase")).alias("phase"), X.cleaned(F.col("conditions")).alias("conditions"), cut("study_design", 200), cut("intervention_name", 200),
        F.substring(F.coalesce("summary_brief", F.lit("")), 1, 600).alias("summary_brief"), X.kept_ids(F.coalesce("source_ids", F.array().cast("array<string>"))).alias("source_ids"),
    )


def change_log_entry(rows: DataFrame) -> DataFrame:
    """protocol_id, version, user_request, assistant_note, changed_fields, ts of a saved version; long texts are cut."""
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n).alias(c)
    return rows.select("protocol_id", "version", cut("user_request", 600), cut("assistant_note", 1500), F.coalesce("changed_fields", F.array().cast("array<string>")).alias("changed_fields"), "ts")


def context(ranked: DataFrame, fields: dict[str, str], rank: str = "rank", by: str | None = None) -> DataFrame:
    """One row (a row for each `by`): the documents' fields as numbered blocks, in order of rank; values "", "0" and "False" are left out.

    An answer's documents are few, as retrieval bounds them; they are numbered in their own array, without a window.
    """
    kept = [F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "False"), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in fields.items()]
    body = F.concat_ws("\n", F.concat(F.lit("NCT ID: "), F.col("doc_id")), *kept)
    rows = ranked.groupBy(*([by] if by else [])).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), "doc_id", body.alias("body")))).alias("b"))
    blocks = F.transform("b", lambda x, i: F.concat(F.lit("<trial id="), (i + 1).cast("string"), F.lit(">\n"), x["body"], F.lit("\n</trial>")))
    return rows.select(*([by] if by else []), F.array_join(blocks, "\n\n").alias("context"))


def feedback_context(turns: DataFrame, sources: DataFrame) -> DataFrame:
    """conv_id, query, assistant_message, source_nct_ids: what a vote on a conversation's last answer is stored with.

    turns: conv_id, turn, role, text; sources: conv_id, ids. The last user text that is not blank, the last answer, and the first 25 ids that aren't blank.
    """
    last = lambda role, keep=None: F.max_by(F.when((F.col("role") == role) & (F.lit(True) if keep is None else keep), F.col("text")), F.when((F.col("role") == role) & (F.lit(True) if keep is None else keep), F.col("turn")))
    said = turns.groupBy("conv_id").agg(F.coalesce(last("user", X.cleaned(F.col("text")) != ""), F.lit("")).alias("query"), F.coalesce(last("assistant"), F.lit("")).alias("assistant_message"))
    return said.join(sources, "conv_id", "left").select("conv_id", "query", "assistant_message", X.kept_ids(F.coalesce("ids", F.array().cast("array<string>"))).alias("source_nct_ids"))
