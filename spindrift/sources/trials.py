"""Reading trial records: delimited files, nested registry JSON, keyed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .files import exists

# Fixed values. Columns of a trial row, in order.
COLUMNS = [
    "nctId", "orgID", "acronym", "bTitle", "oTitle", "sponsorName", "sponsorClass", "collaborators", "responsiblePartyType", "oStatus", "statusBTS",
    "startDate", "startDateType", "primaryCompletionDate", "primaryCompletionDateType", "completionETA", "completionETAType", "studyFST", "lastUpdateDate",
    "summary", "description", "conditions", "keywords", "meshTermsCondition", "meshTermsIntervention", "studyType", "phases", "allocation",
    "interventionModel", "primaryPurpose", "masking", "enrollmentCont", "enrollmentType", "armGroups", "interventionName", "interventionType",
    "interventionDescription", "interventionOtherNames", "includeCriteria", "excludeCriteria", "sex", "minimumAge", "maximumAge", "healthyVolunteers",
    "stdAges", "primaryOutcomes", "secondaryOutcomes", "piName", "piAffiliation", "contactInfo", "locationInfo", "locationCount", "locationCountries",
    "isFdaRegulatedDrug", "isFdaRegulatedDevice",
]
COUNTS = {"enrollmentCont", "locationCount"}
TRIAL = T.StructType([T.StructField(c, T.IntegerType() if c in COUNTS else T.StringType()) for c in COLUMNS])
# Fixed values. Texts that count as missing in delimited files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

STUDY = """
protocolSection struct<
 identificationModule: struct<nctId: string, orgStudyIdInfo: struct<id: string>, acronym: string, briefTitle: string, officialTitle: string>,
 statusModule: struct<overallStatus: string, statusVerifiedDate: string, startDateStruct: struct<date: string, type: string>,
  primaryCompletionDateStruct: struct<date: string, type: string>, completionDateStruct: struct<date: string, type: string>,
  studyFirstSubmitDate: string, lastUpdatePostDateStruct: struct<date: string>>,
 descriptionModule: struct<briefSummary: string, detailedDescription: string>,
 conditionsModule: struct<conditions: array<string>, keywords: array<string>>,
 designModule: struct<studyType: string, phases: array<string>, designInfo: struct<allocation: string, interventionModel: string,
  primaryPurpose: string, maskingInfo: struct<masking: string>>, enrollmentInfo: struct<count: int, type: string>>,
 eligibilityModule: struct<eligibilityCriteria: string, sex: string, minimumAge: string, maximumAge: string, healthyVolunteers: boolean, stdAges: array<string>>,
 contactsLocationsModule: struct<overallOfficials: array<struct<name: string, role: string, affiliation: string>>,
  centralContacts: array<struct<name: string, role: string, email: string>>,
  locations: array<struct<facility: string, status: string, city: string, state: string, country: string>>>,
 armsInterventionsModule: struct<interventions: array<struct<name: string, type: string, description: string, otherNames: array<string>>>,
  armGroups: array<struct<label: string, type: string, description: string>>>,
 outcomesModule: struct<primaryOutcomes: array<struct<measure: string, description: string, timeFrame: string>>,
  secondaryOutcomes: array<struct<measure: string, description: string, timeFrame: string>>>,
 sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string, class: string>, collaborators: array<struct<name: string, class: string>>,
  responsibleParty: struct<type: string>>,
 oversightModule: struct<isFdaRegulatedDrug: boolean, isFdaRegulatedDevice: boolean>>,
derivedSection struct<conditionBrowseModule: struct<meshes: array<struct<term: string>>>, interventionBrowseModule: struct<meshes: array<struct<term: string>>>>
"""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All 55 columns; texts that mean "missing" and absent columns become "" (counts stay null)."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    have = set(raw.columns)

    def column(field: T.StructField) -> Column:
        own = F.col(f"`{field.name}`") if field.name in have else F.lit(None).cast("string")
        own = F.when(~own.isin(MISSING), own)
        if field.name in COUNTS:
            return own.try_cast("double").cast("int").alias(field.name)
        return F.coalesce(own, F.lit("")).alias(field.name)

    return raw.select(*map(column, TRIAL.fields))


def latest_by_key(rows: DataFrame, key: str = "nctId", order: str = "pos") -> DataFrame:
    """The last row of each key that is not blank."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_last", last).filter("_last = 1").drop("_last")


def updated_since(trials: DataFrame, since: str) -> DataFrame:
    return trials.filter(F.col("lastUpdateDate") >= since).orderBy("lastUpdateDate", "nctId")


def _text(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def _joined(c: Column, each=None, by: str = ", ") -> Column:
    """Elements, rendered by each, joined; a null array gives ""."""
    parts = F.transform(c, each) if each else c
    return F.coalesce(F.array_join(parts, by), F.lit(""))


def parse_studies(studies: DataFrame) -> DataFrame:
    """Nested studies (columns of STUDY) as flat trial rows."""
    s = lambda path: F.col(f"protocolSection.{path}")
    names = lambda path, field: _joined(F.filter(F.transform(s(path), lambda x: x[field]), lambda v: _text(v) != ""))
    outcome = lambda o: F.concat(_text(o["measure"]), F.lit(": "), _text(o["description"]), F.lit(" ["), _text(o["timeFrame"]), F.lit("]"))
    na = lambda v: _text(v, "N/A")
    officials = s("contactsLocationsModule.overallOfficials")
    lead = F.try_element_at(F.filter(officials, lambda o: o["role"] == "PRINCIPAL_INVESTIGATOR"), F.lit(1))
    named = _text(lead["name"]) != ""
    anyone = F.try_element_at(officials, F.lit(1))
    include, exclude = X.criteria(s("eligibilityModule.eligibilityCriteria"))
    sites = s("contactsLocationsModule.locations")
    lands = F.array_sort(F.array_distinct(F.filter(F.transform(sites, lambda x: x["country"]), lambda c: _text(c) != "")))
    arms = "armsInterventionsModule.interventions"
    truth = lambda c: F.coalesce(F.initcap(c.cast("string")), F.lit(""))
    mesh = lambda m: _joined(F.col(f"derivedSection.{m}.meshes"), lambda x: _text(x["term"]))
    plain = {
        "nctId": "identificationModule.nctId", "orgID": "identificationModule.orgStudyIdInfo.id", "acronym": "identificationModule.acronym",
        "bTitle": "identificationModule.briefTitle", "oTitle": "identificationModule.officialTitle",
        "sponsorName": "sponsorCollaboratorsModule.leadSponsor.name", "sponsorClass": "sponsorCollaboratorsModule.leadSponsor.class",
        "responsiblePartyType": "sponsorCollaboratorsModule.responsibleParty.type", "oStatus": "statusModule.overallStatus",
        "statusBTS": "statusModule.statusVerifiedDate", "startDate": "statusModule.startDateStruct.date", "startDateType": "statusModule.startDateStruct.type",
        "primaryCompletionDate": "statusModule.primaryCompletionDateStruct.date", "primaryCompletionDateType": "statusModule.primaryCompletionDateStruct.type",
        "completionETA": "statusModule.completionDateStruct.date", "completionETAType": "statusModule.completionDateStruct.type",
        "studyFST": "statusModule.studyFirstSubmitDate", "lastUpdateDate": "statusModule.lastUpdatePostDateStruct.date",
        "summary": "descriptionModule.briefSummary", "description": "descriptionModule.detailedDescription", "studyType": "designModule.studyType",
        "allocation": "designModule.designInfo.allocation", "interventionModel": "designModule.designInfo.interventionModel",
        "primaryPurpose": "designModule.designInfo.primaryPurpose", "masking": "designModule.designInfo.maskingInfo.masking",
        "enrollmentType": "designModule.enrollmentInfo.type", "minimumAge": "eligibilityModule.minimumAge", "maximumAge": "eligibilityModule.maximumAge",
    }
    made = {c: _text(s(path)) for c, path in plain.items()} | {
        "collaborators": _joined(s("sponsorCollaboratorsModule.collaborators"), lambda c: F.concat(_text(c["name"]), F.lit(" ("), _text(c["class"]), F.lit(")"))),
        "conditions": _joined(s("conditionsModule.conditions")), "keywords": _joined(s("conditionsModule.keywords")),
        "meshTermsCondition": mesh("conditionBrowseModule"), "meshTermsIntervention": mesh("interventionBrowseModule"),
        "phases": _joined(s("designModule.phases")), "enrollmentCont": F.coalesce(s("designModule.enrollmentInfo.count"), F.lit(0)),
        "armGroups": _joined(s("armsInterventionsModule.armGroups"), lambda a: F.concat(_text(a["label"]), F.lit(": "), _text(a["type"]), F.lit(" - "), _text(a["description"])), " | "),
        "interventionName": names(arms, "name"), "interventionType": names(arms, "type"), "interventionDescription": names(arms, "description"),
        "interventionOtherNames": _joined(F.flatten(F.transform(s(arms), lambda i: F.coalesce(i["otherNames"], F.array().cast("array<string>"))))),
        "includeCriteria": include, "excludeCriteria": exclude, "sex": _text(s("eligibilityModule.sex"), "ALL"),
        "healthyVolunteers": truth(s("eligibilityModule.healthyVolunteers")), "stdAges": _joined(s("eligibilityModule.stdAges")),
        "primaryOutcomes": _joined(s("outcomesModule.primaryOutcomes"), outcome, " | "), "secondaryOutcomes": _joined(s("outcomesModule.secondaryOutcomes"), outcome, " | "),
        "piName": _text(F.when(named, lead["name"]).otherwise(anyone["name"])), "piAffiliation": _text(F.when(named, lead["affiliation"]).otherwise(anyone["affiliation"])),
        "contactInfo": _joined(s("contactsLocationsModule.centralContacts"), lambda c: F.concat(na(c["name"]), F.lit(" ("), na(c["role"]), F.lit(") - "), na(c["email"]))),
        "locationInfo": _joined(sites, lambda x: F.concat(na(x["facility"]), F.lit(" ("), na(x["status"]), F.lit(") - "), na(x["city"]), F.lit(", "), na(x["state"]), F.lit(", "), na(x["country"]))),
        "locationCount": F.coalesce(F.size(sites), F.lit(0)), "locationCountries": F.coalesce(F.array_join(lands, ", "), F.lit("")),
        "isFdaRegulatedDrug": truth(s("oversightModule.isFdaRegulatedDrug")), "isFdaRegulatedDevice": truth(s("oversightModule.isFdaRegulatedDevice")),
    }
    return studies.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in TRIAL.fields])


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """Registry JSON, one study a line; lines that are not JSON are dropped."""
    return parse_studies(spark.read.schema(STUDY).option("mode", "DROPMALFORMED").json(path))


def write_csv(trials: DataFrame, path: str) -> None:
    """All 55 columns in their order, other columns left out."""
    trials.select(*COLUMNS).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry's JSON (one object a file or a line); no rows where nothing is stored yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
