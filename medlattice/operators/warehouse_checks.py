"""The warehouse's data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import constraints, history
from .quality import Check, null_rate
from .shred import EXPECTED_SYSTEM

#: Fixed values: (table, column, largest share of nulls).
NULL_LIMITS = [("patient", "birth_date", 0.02), ("patient", "gender", 0.02), ("encounter", "period_start", 0.01), ("encounter", "service_provider_id", 0.05), ("encounter", "primary_performer_id", 0.15), ("observation", "effective_datetime", 0.01), ("condition", "onset_datetime", 0.05), ("patient_address", "city", 0.02), ("fact.encounter", "length_of_stay_days", 0.40)]
LONGEST_STAY = 365

Tables = Mapping[str, DataFrame]


def _said(df: DataFrame, failure: str, key: str) -> DataFrame:
    return df.select(F.lit(failure).alias("failure"), F.col(key).cast("string").alias("member"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def foreign_keys(t: Tables) -> DataFrame:
    return constraints.foreign_key_violations(t)


def checks_hold(t: Tables) -> DataFrame:
    return constraints.check_violations(t)


def fact_orphans(t: Tables) -> DataFrame:
    return constraints.foreign_key_violations({k: t[k] for k in t if k.startswith(("fact.", "dw."))})


def history_sound(t: Tables) -> DataFrame:
    return history.integrity(t["dw.patient"].where("patient_key != -1"), "patient_id")


def layers_agree(t: Tables) -> DataFrame:
    """Counts between layers, and the identity of every result: own values and the components in the documents."""
    r = t["reconciliation"].where("norm_rows != fact_rows or raw_rows != norm_rows + unresolved_rows")
    o = t["observation"].select("observation_id").subtract(t["fact.observation"].select("observation_id"))
    c = t["source_components"].join(t["fact.observation"].select("observation_id", F.col("component_seq").cast("int").alias("component_seq")), ["observation_id", "component_seq"], "left_anti")
    return _union(_said(r, "layers differ", "resource_type"), _said(o.where(F.lit(True)), "result missing", "observation_id"), _said(c, "component missing", "observation_id"))


def natural_keys(t: Tables) -> DataFrame:
    return constraints.natural_key_violations(t)


def null_limits(t: Tables) -> DataFrame:
    rows = [null_rate(t[name], c, f"{name}.{c}").withColumn("most", F.lit(most)) for name, c, most in NULL_LIMITS if name in t]
    return _union(*rows).where("rate > most")


def plausible(t: Tables) -> DataFrame:
    later = F.lit(t["as_of"].first()[0]).cast("timestamp_ntz") + F.expr("interval 1 day")
    e, p = t["encounter"], t["patient"]
    return _union(
        _said(t["observation"].where(F.col("effective_datetime") > later), "result in the future", "observation_id"), _said(e.where("period_end < period_start"), "ends before it starts", "encounter_id"),
        _said(t["fact.encounter"].where("length_of_stay_days < 0"), "negative stay", "encounter_id"), _said(t["fact.encounter"].where(f"length_of_stay_days > {LONGEST_STAY}"), "stay over a year", "encounter_id"),
        _said(p.where("birth_date > cast(deceased_datetime as date)"), "died before birth", "patient_id"), _said(p.where("birth_date < date '1890-01-01'"), "born too early", "patient_id"),
        _said(e.join(p.select("patient_id", "birth_date"), "patient_id").where("cast(period_start as date) < birth_date"), "seen before birth", "encounter_id"),
        _said(t["procedure"].where("performed_end < performed_start"), "procedure reversed", "procedure_id"), _said(t["condition"].where("abatement_datetime < onset_datetime"), "condition reversed", "condition_id"),
    )


def vocabulary(t: Tables) -> DataFrame:
    code = t["code"]
    out = []
    for table, kind, key in (("condition", "Condition", "condition_id"), ("observation", "Observation", "observation_id"), ("medication_request", "MedicationRequest", "medication_request_id")):
        out.append(_said(t[table].join(code.where(F.col("system") != EXPECTED_SYSTEM[kind]), "code_concept_id"), f"{kind}: other vocabulary", key))
    out.append(_said(code.where(C.blank(F.col("code"))), "blank code", "code_concept_id"))
    out.append(_said(code.groupBy("system", "code").agg(F.count("*").alias("n")).where("n > 1"), "code twice", "code"))
    return _union(*out)


def quarantine(t: Tables) -> DataFrame:
    r, b = t["stg.rejects"], t["meta.load_batch"].where("status = 'succeeded'")
    return _union(
        _said(r.where(C.blank(F.col("reason"))), "no reason", "source_ref"), _said(r.where("failure_stage is null"), "no stage", "source_ref"), _said(r.where("failure_stage != 'parse' and payload is null"), "no payload", "source_ref"),
        _said(b.where("n_read != n_accepted + n_duplicate + n_rejected"), "counts don't add up", "batch_id"),
        _said(r.groupBy("batch_id").agg(F.count("*").alias("n")).join(b, "batch_id").where("n != n_rejected"), "rejects differ from the batch", "batch_id"),
    )


def precision(t: Tables) -> DataFrame:
    """Results that the source gives as something but the table as 0 (current versions only)."""
    return _said(t["observation"].join(t["source_values"], "observation_id").where("value_quantity = 0 and try_cast(source_value as double) != 0"), "value lost", "observation_id")


CHECKS = [
    Check("RI-01", "error", "references find their parents", foreign_keys), Check("RI-02", "error", "declared checks hold", checks_hold), Check("RI-03", "error", "facts find their dimensions", fact_orphans),
    Check("SCD-01", "error", "patient history is sound", history_sound), Check("REC-01", "error", "layers agree", layers_agree), Check("DUP-01", "error", "natural keys are unique", natural_keys), Check("NULL-01", "error", "null shares stay below their limits", null_limits),
    Check("DOM-01", "error", "dates and stays are plausible", plausible), Check("TERM-01", "error", "codes are of the expected vocabulary", vocabulary), Check("QUAR-01", "error", "quarantine is complete", quarantine), Check("DOM-02", "warn", "values keep their precision", precision),
]
