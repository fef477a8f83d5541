"""Semantic views over the star, and the measures that reports use."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import measures
from ..functions.columns import OPEN_END, ratio

Tables = Mapping[str, DataFrame]


def encounter(f: Tables, d: Tables) -> DataFrame:
    """V1: one row for each encounter, with its dimensions' descriptions."""
    e = f["encounter"].join(d["encounter_type"].select("encounter_type_key", "class_code", "class_display", "type_display", "care_setting"), "encounter_type_key")
    e = e.join(d["organization"].select("organization_key", "organization_id", F.col("name").alias("organization")), "organization_key").join(d["provider"].select("provider_key", F.col("full_name").alias("provider")), "provider_key")
    e = e.join(d["patient"].select("patient_key", "age_band", F.col("gender").alias("patient_gender")), "patient_key")
    return e.join(d["date"].select(F.col("date_key").cast("int").alias("start_date_key"), F.col("full_date").alias("start_date"), "month_year", "fiscal_year", "fiscal_quarter"), "start_date_key")


def volume_monthly(f: Tables, d: Tables) -> DataFrame:
    """V2; patients are counted by business key, so that a patient with two versions is one."""
    return encounter(f, d).where("start_date_key != -1").groupBy("month_year", "care_setting").agg(
        F.count("*").alias("encounters"), F.countDistinct("patient_id").alias("patients"), F.sum("length_of_stay_days").cast("double").alias("stay_days"), F.round(F.avg(F.col("length_of_stay_days").cast("double")), 4).alias("mean_stay_days"))


def observation_result(f: Tables, d: Tables) -> DataFrame:
    """V3: one row for each result."""
    o = f["observation"].join(d["observation_code"].select("observation_code_key", F.col("code").alias("observation_code"), F.col("display").alias("observation")), "observation_code_key")
    o = o.join(d["date"].select(F.col("date_key").cast("int").alias("effective_date_key"), F.col("full_date").alias("effective_date"), "month_year", "fiscal_year", "fiscal_quarter"), "effective_date_key")
    return o.join(encounter(f, d).select("encounter_id", "care_setting", "organization"), "encounter_id", "left")


def observation_band(f: Tables, d: Tables) -> DataFrame:
    """V4."""
    return measures.reference_band(observation_result(f, d).where("is_numeric = 1"), ["observation_code"], "value_quantity")


def observation_outlier(f: Tables, d: Tables) -> DataFrame:
    """V5: numeric results of banded codes."""
    return measures.outliers(observation_result(f, d), observation_band(f, d), ["observation_code"], "value_quantity")


def medication_order(f: Tables, d: Tables) -> DataFrame:
    """V6."""
    m = f["medication_order"].join(d["medication"].select("medication_key", F.col("code").alias("medication_code"), F.col("display").alias("medication")), "medication_key")
    return m.join(encounter(f, d).select("encounter_id", "care_setting", "organization"), "encounter_id", "left")


def diagnosis(f: Tables, d: Tables) -> DataFrame:
    """V7."""
    c = f["encounter_diagnosis"].join(d["diagnosis"].select("diagnosis_key", F.col("code").alias("diagnosis_code"), F.col("display").alias("diagnosis")), "diagnosis_key")
    return c.join(encounter(f, d).select("encounter_id", "care_setting", "organization"), "encounter_id", "left")


def patient_panel(f: Tables, d: Tables, months: int = 24) -> DataFrame:
    """V8: current patients; visits are found by business key, so that earlier versions' visits count."""
    people = d["patient"].where("is_current and patient_key != -1").select("patient_id", "patient_key", "age_band", "gender", "city", "state")
    visits = f["encounter"].where("start_date_key != -1").select("patient_id", F.to_date(F.col("start_date_key").cast("string"), "yyyyMMdd").alias("visit_date"))
    return measures.panel(people, visits, "patient_id", "visit_date", months)


def readmission_rate(f: Tables, d: Tables) -> DataFrame:
    """V9."""
    e = encounter(f, d).where("is_inpatient = 1 and start_date_key != -1")
    return measures.rate_by(e, ["month_year"], "is_readmission", "discharges", "readmissions", "readmission_rate")


def organization_scorecard(f: Tables, d: Tables) -> DataFrame:
    """V10."""
    return encounter(f, d).groupBy("organization").agg(F.count("*").alias("encounters"), F.countDistinct("patient_id").alias("patients"), F.countDistinct("provider_key").alias("providers"), F.sum("is_readmission").alias("readmissions"), ratio(F.sum("is_readmission"), F.sum("is_inpatient")).alias("readmission_rate"))


def feasibility(f: Tables, d: Tables) -> DataFrame:
    """V11: adults, diabetes, hypertension and a lab result; and all of them."""
    adults = d["patient"].where("is_current and patient_key != -1 and age_band not in ('00-17', 'Unknown')").select("patient_id")
    dx = diagnosis(f, d)
    said = lambda word: dx.where(F.ilike("diagnosis", F.lit(f"%{word}%"))).select("patient_id")
    labs = f["observation"].where("is_numeric = 1").select("patient_id")
    return measures.funnel([("adults", adults), ("diabetes or hypertension", said("diabetes").union(said("hypertension"))), ("numeric lab result", labs), ("active in 24 months", patient_panel(f, d).where("is_active = 1").select("patient_id"))], "patient_id")


def reconciliation(current: DataFrame, norm: Tables, f: Tables) -> DataFrame:
    """V12: documents, normalized rows and facts of each type."""
    pairs = [("Encounter", "encounter", "encounter"), ("Observation", "observation", None), ("Condition", "condition", "encounter_diagnosis"), ("Procedure", "procedure", "procedure"), ("MedicationRequest", "medication_request", "medication_order")]
    raw = current.groupBy("resource_type").agg(F.count("*").alias("raw_rows"))
    rows = None
    for kind, n, fact in pairs:
        facts = f[fact].agg(F.count("*").alias("fact_rows")) if fact else f["observation"].agg(F.countDistinct("observation_id").alias("fact_rows"))
        row = norm[n].agg(F.count("*").alias("norm_rows")).crossJoin(facts).withColumn("resource_type", F.lit(kind))
        rows = row if rows is None else rows.unionByName(row)
    return rows.join(raw, "resource_type", "left").select("resource_type", F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"), "norm_rows", "fact_rows")


def bi_measures(f: Tables, d: Tables) -> DataFrame:
    """(measure, value) of the report's measures."""
    e, out = encounter(f, d), observation_outlier(f, d)
    panel = patient_panel(f, d)
    stay = F.col("length_of_stay_days").cast("double")
    inpatient = e.where("is_inpatient = 1")
    one = lambda name, df, agg: df.agg(agg.cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")
    rows = [
        one("encounters", e, F.count("*")), one("inpatient discharges", inpatient.where("end_date_key != -1"), F.count("*")), one("readmissions", inpatient, F.sum("is_readmission")), one("readmission rate", inpatient, ratio(F.sum("is_readmission"), F.count("*"))),
        one("mean stay", inpatient, F.avg(stay)), one("median stay", inpatient.withColumn("s", stay), F.median("s")), one("active patients", panel, F.sum("is_active")), one("patients seen", e, F.countDistinct("patient_id")),
        one("patient versions seen", e, F.countDistinct("patient_key")), one("numeric results", f["observation"], F.sum("is_numeric")), one("outliers", out, F.sum("is_outlier")), one("outlier rate of banded results", out, ratio(F.sum("is_outlier"), F.count("*"))),
        one("feasible patients", feasibility(f, d).where("criterion = 'all criteria'"), F.max("n")),
    ]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result


def quality_measures(f: Tables, d: Tables) -> DataFrame:
    """Patients by number of versions and a few totals, as the build reports them."""
    versions = d["patient"].where("patient_key != -1").groupBy("patient_id").agg(F.count("*").alias("n"))
    one = lambda name, df, agg: df.agg(agg.cast("long").alias("value")).select(F.lit(name).alias("measure"), "value")
    rows = [one("patients with two versions", versions, F.count_if(F.col("n") == 2)), one("most versions of a patient", versions, F.max("n")), one("inpatient encounters", f["encounter"], F.sum("is_inpatient")), one("readmissions", f["encounter"], F.sum("is_readmission")), one("open current rows", d["patient"], F.count_if((F.col("effective_to") == F.lit(OPEN_END).cast("date")) & F.col("is_current")))]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result


def benchmark_trend(f: Tables, d: Tables) -> DataFrame:
    """Monthly mean by age band for the most frequent result code."""
    r = observation_result(f, d).where("is_numeric = 1")
    return r.join(measures.top(r, ["observation_code"], 1).select("observation_code"), "observation_code", "left_semi").join(d["patient"].select("patient_key", "age_band"), "patient_key").groupBy("month_year", "age_band").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value_quantity").cast("double")), 6).alias("mean"))


def benchmark_quarters(f: Tables, d: Tables) -> DataFrame:
    """Count, mean and extremes for each code and fiscal quarter."""
    v = F.col("value_quantity").cast("double")
    return observation_result(f, d).where("is_numeric = 1").groupBy("observation_code", "fiscal_year", "fiscal_quarter").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
