"""Tabulation domains DM, AE and VS, and their conformance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .edc import VISITS

#: Fixed values.
STUDY = "STUDY01"
REQUIRED = {"DM": ["STUDYID", "DOMAIN", "USUBJID", "SUBJID", "SITEID", "SEX", "ARMCD"], "AE": ["STUDYID", "DOMAIN", "USUBJID", "AESEQ", "AETERM", "AESEV", "AESER"], "VS": ["STUDYID", "DOMAIN", "USUBJID", "VSSEQ", "VSTESTCD", "VSTEST", "VSORRES"]}
VS_TESTS = [("SYSBP", "Systolic Blood Pressure", "mmHg"), ("DIABP", "Diastolic Blood Pressure", "mmHg"), ("PULSE", "Pulse Rate", "beats/min"), ("TEMP", "Temperature", "C"), ("WEIGHT", "Weight", "kg")]


def _head(domain: str, study: str):
    return [F.lit(study).alias("STUDYID"), F.lit(domain).alias("DOMAIN"), F.concat(F.lit(f"{study}-"), F.col("subject_id")).alias("USUBJID")]


def _visits(df: DataFrame) -> DataFrame:
    v = df.sparkSession.createDataFrame([(a, c, b) for a, b, c, *_ in VISITS], "visit_id string, VISIT string, VISITNUM int")
    return df.join(F.broadcast(v), "visit_id", "left")


def dm(records: DataFrame, subjects: DataFrame, study: str = STUDY) -> DataFrame:
    """One row for each subject, with or without a demographics record; age in completed years at consent."""
    own = records.where("form_id = 'DM'").groupBy("subject_id").agg(F.max_by(F.struct("BRTHDAT", "SEX", "RFICDAT", "ARM"), "ord").alias("r")).select("subject_id", "r.*")
    given = subjects.withColumnRenamed("arm", "subjects_arm") if "arm" in subjects.columns else subjects.withColumn("subjects_arm", F.lit(None).cast("string"))
    d = given.join(own, "subject_id", "left")
    arm, consent = F.coalesce("ARM", F.col("subjects_arm")), F.coalesce("RFICDAT", "consent_date")
    born = ~C.blank(F.col("BRTHDAT"))
    return d.select(*_head("DM", study), F.col("subject_id").alias("SUBJID"), F.col("site_id").alias("SITEID"), F.coalesce("BRTHDAT", F.lit("")).alias("BRTHDTC"), F.when(born, C.completed_years(C.calendar_date(F.col("BRTHDAT")), C.calendar_date(consent))).alias("AGE"),
        F.when(born, "YEARS").otherwise("").alias("AGEU"), F.coalesce("SEX", F.lit("")).alias("SEX"), arm.alias("ARMCD"), F.when(arm == "A", "Investigational product").otherwise("Placebo").alias("ARM"), consent.alias("RFICDTC"), F.lit("CAN").alias("COUNTRY"))


def ae(records: DataFrame, coded: DataFrame | None = None, study: str = STUDY) -> DataFrame:
    """One row for each event, numbered within the subject by start, term, visit and record; coded (verbatim, coded) fills AEDECOD."""
    e = _visits(records.where((F.col("form_id") == "AE") & ~C.blank(F.col("AETERM"))))
    w = Window.partitionBy("subject_id").orderBy(F.coalesce("AESTDAT", F.lit("")), "AETERM", "visit_id", "record_num")
    e = e.withColumn("AESEQ", F.row_number().over(w))
    e = e.join(coded.select(F.col("verbatim").alias("AETERM"), F.col("coded").alias("AEDECOD")).distinct(), "AETERM", "left") if coded is not None else e.withColumn("AEDECOD", F.lit(""))
    text = lambda c, to: F.coalesce(F.col(c), F.lit("")).alias(to)
    return e.select(*_head("AE", study), "AESEQ", "AETERM", text("AEDECOD", "AEDECOD"), text("AESTDAT", "AESTDTC"), text("AEENDAT", "AEENDTC"), *(text(c, c) for c in ("AESEV", "AESER", "AEREL", "AEOUT", "AEACN")), text("VISIT", "VISIT"), "VISITNUM")


def vs(records: DataFrame, study: str = STUDY) -> DataFrame:
    """Five columns to rows; what was not collected gives none. Numbered within the subject by visit, record and test."""
    r = _visits(records.where("form_id = 'VS'"))
    tests = r.sparkSession.createDataFrame([(t, name, unit, i) for i, (t, name, unit) in enumerate(VS_TESTS)], "VSTESTCD string, VSTEST string, VSORRESU string, test_order int")
    keep = ["subject_id", "VISIT", "VISITNUM", "ord", F.coalesce("VSDAT", F.lit("")).alias("VSDTC")]
    long = r.select(*keep, *(t for t, *_ in VS_TESTS)).unpivot(["subject_id", "VISIT", "VISITNUM", "ord", "VSDTC"], [t for t, *_ in VS_TESTS], "VSTESTCD", "VSORRES")
    long = long.withColumn("VSORRES", C.filled(F.col("VSORRES"))).where("VSORRES is not null").join(F.broadcast(tests), "VSTESTCD")
    w = Window.partitionBy("subject_id").orderBy(F.coalesce("VISITNUM", F.lit(99)), "ord", "test_order")
    long = long.withColumn("VSSEQ", F.row_number().over(w))
    return long.select(*_head("VS", study), "VSSEQ", "VSTESTCD", "VSTEST", "VSORRES", "VSORRESU", F.col("VSORRES").alias("VSSTRESN"), F.col("VSORRESU").alias("VSSTRESU"), "VSDTC", F.coalesce("VISIT", F.lit("")).alias("VISIT"), "VISITNUM")


def conformance(domain: str, rows: DataFrame, strict: bool = False) -> DataFrame:
    """(domain, rule, severity, records) of broken rules: required variables, ISO dates (by shape; strict: also real dates), sequence
    numbers unique within the subject. An empty domain breaks none."""
    def rule(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("records")).where("records > 0").select(F.lit(domain).alias("domain"), F.lit(name).alias("rule"), F.lit("error").alias("severity"), "records")

    out = [rule(f"{v} is required", rows.where(C.blank(F.col(v).cast("string")))) for v in REQUIRED[domain]]
    for v in [c for c in rows.columns if c.endswith("DTC")]:
        good = F.col(v).rlike(r"^.{4}-.{2}-.{2}$") & (C.calendar_date(F.col(v)).isNotNull() if strict else F.lit(True))
        out.append(rule(f"{v} must be ISO 8601 (YYYY-MM-DD)", rows.where(~C.blank(F.col(v)) & ~good)))
    if f"{domain}SEQ" in rows.columns:
        again = rows.groupBy("USUBJID", f"{domain}SEQ").agg((F.count("*") - 1).alias("extra")).where("extra > 0")
        again = again.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("records")).where("records > 0").select(F.lit(domain).alias("domain"), F.lit(f"{domain}SEQ must be unique within USUBJID").alias("rule"), F.lit("error").alias("severity"), "records")
        out.append(again)
    return reduce(DataFrame.unionByName, out)
