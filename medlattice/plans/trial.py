"""The trial pipeline: items to records, checks, domains, coding, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coding, edc, release, sdtm
from ..shared import written


def run(items: DataFrame, subjects: DataFrame, study: str = sdtm.STUDY) -> dict[str, DataFrame]:
    """All tables of the pipeline from long items (with ord, their place in the input) and subjects."""
    spark = items.sparkSession
    rec = written(edc.records(items), "records")  # six consumers
    terms = rec.where("form_id = 'AE' and trim(AETERM) != ''").select(F.col("AETERM").alias("verbatim"), "ord")
    reactions = coding.code_terms(terms, "verbatim", coding.dictionary(spark, coding.REACTIONS, own=True), coding.dictionary(spark, coding.REACTION_SYNONYMS), coding.dictionary(spark, coding.REACTION_AMBIGUOUS))
    drugs = coding.code_terms(rec.where("form_id = 'CM' and trim(CMTRT) != ''").select(F.col("CMTRT").alias("verbatim"), "ord"), "verbatim", coding.dictionary(spark, coding.DRUGS, own=True), coding.dictionary(spark, coding.DRUG_SYNONYMS), None)
    t = {
        "records": rec, "queries": edc.run_checks(items, subjects), "dm": sdtm.dm(rec, subjects, study), "ae": sdtm.ae(rec, reactions, study), "vs": sdtm.vs(rec, study),
        "coding": reactions.withColumn("dictionary", F.lit(coding.DICTIONARIES[0])).unionByName(drugs.withColumn("dictionary", F.lit(coding.DICTIONARIES[1]))), "uat": edc.test_cases(spark),
    }
    t["worklist"] = coding.worklist(t["coding"], "verbatim", "ord")
    t["sdtm_conformance"] = sdtm.conformance("DM", t["dm"]).unionByName(sdtm.conformance("AE", t["ae"])).unionByName(sdtm.conformance("VS", t["vs"]))
    return t


def decide(t: dict[str, DataFrame], evidence: dict[str, DataFrame], metrics: dict) -> DataFrame:
    """(gate_id, status) of the seven gates and the decision."""
    gates = release.trial_gates({**t, **evidence}, metrics)
    return gates.unionByName(release.decision(gates).select(F.lit("DECISION").alias("gate_id"), F.col("decision").alias("status")))
