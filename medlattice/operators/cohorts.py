"""Cohort selection and the aggregates that reports show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import measures
from .release import fingerprint


def filter_cohort(data: dict[str, DataFrame], sites: Sequence[str], arms: Sequence[str], start: str, end: str, key: str = "subject_id") -> dict[str, DataFrame]:
    """Subjects of the sites and arms with consent in the closed range, and the rows of every other table that are theirs."""
    s = data["subjects"].where(F.col("site_id").isin(*sites) & F.col("arm").isin(*arms) & C.calendar_date(F.col("consent_date")).between(start, end))
    return {n: s if n == "subjects" else df.join(s.select(key), key, "left_semi") if key in df.columns else df for n, df in data.items()}


def enriched(events: DataFrame, dm: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Events with columns of the one DM row of their subject; a subject with two is an error."""
    if dm.groupBy("USUBJID").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("DM holds a subject twice")
    return events.join(dm.select("USUBJID", *columns), "USUBJID", "left")


def register(cohorts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(cohort_id, definition, subjects, member_fingerprint) of each cohort (subject_id)."""
    out = None
    for name, (definition, df) in cohorts.items():
        row = df.agg(F.countDistinct("subject_id").alias("subjects"), fingerprint("subject_id").alias("member_fingerprint")).select(F.lit(name).alias("cohort_id"), F.lit(definition).alias("definition"), "subjects", "member_fingerprint")
        out = row if out is None else out.unionByName(row)
    return out


def site_table(subjects: DataFrame) -> DataFrame:
    return subjects.groupBy("site_id").agg(F.count("*").alias("subjects"), F.count_if(F.col("arm") == "A").alias("arm_a"), F.count_if(F.col("arm") == "B").alias("arm_b"), F.count_if(F.col("completed") == "1").alias("completed"), F.min("consent_date").alias("first_consent"), F.max("consent_date").alias("last_consent"))


def enrolment(subjects: DataFrame) -> DataFrame:
    """Subjects by site and month, and the running total of each site."""
    m = subjects.groupBy("site_id", F.trunc(C.calendar_date(F.col("consent_date")), "MM").alias("month")).agg(F.count("*").alias("n"))
    return measures.running_total(m, ["site_id"], ["month"], "n")


def tiles(dm: DataFrame, subjects: DataFrame, ae: DataFrame) -> DataFrame:
    """(measure, value): median, least and greatest age, share completed, share serious."""
    one = lambda name, df, c: df.agg(c.cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")
    rows = [one("median age", dm, F.median("AGE")), one("least age", dm, F.min("AGE")), one("greatest age", dm, F.max("AGE")), one("share completed", subjects, F.avg((F.col("completed") == "1").cast("int"))), one("share serious", ae, F.avg((F.col("AESER") == "Y").cast("int")))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def vital_extremes(vs: DataFrame) -> DataFrame:
    """Vital signs beyond three interquartile ranges of their test."""
    v = vs.withColumn("value", F.col("VSSTRESN").try_cast("double")).where("value is not null")
    return measures.iqr_fence(v, ["VSTESTCD"], "value")


def long_form(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "kind", "n")
