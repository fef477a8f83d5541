"""Declared constraints as violation queries, since Parquet tables hold none."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gate import ENCOUNTER_STATUS, GENDERS, MEDICATION_INTENT, MEDICATION_STATUS, OBSERVATION_STATUS, PROCEDURE_STATUS
from .tables import duplicates, orphans

_in = lambda c, values, null=True: (f"{c} is null or " if null else "") + f"{c} in ({', '.join(repr(v) for v in values)})"

#: Fixed values: (table, name, predicate that every row meets). A null predicate counts as met.
CHECKS = [
    ("meta.load_batch", "batch_status", _in("status", ("running", "succeeded", "failed"), False)),
    ("meta.load_batch", "batch_kind", _in("batch_kind", ("bulk", "rest", "changefeed"), False)),
    ("raw.document", "is_json", "try_parse_json(payload) is not null"),
    ("raw.document", "type_matches", "get_json_object(payload, '$.resourceType') = resource_type"),
    ("raw.document", "id_matches", "get_json_object(payload, '$.id') = resource_id"),
    ("stg.rejects", "stage", _in("failure_stage", ("parse", "schema", "reference", "constraint"), False)),
    ("practitioner", "gender", _in("gender", GENDERS)),
    ("patient", "gender", _in("gender", GENDERS)),
    ("patient", "birth_before_death", "deceased_datetime >= birth_date"),
    ("encounter", "status", _in("status", ENCOUNTER_STATUS, False)),
    ("encounter", "class", _in("class_code", ("AMB", "EMER", "FLD", "HH", "IMP", "ACUTE", "NONAC", "OBSENC", "PRENC", "SS", "VR"), False)),
    ("encounter", "period", "period_end >= period_start"),
    ("condition", "clinical_status", _in("clinical_status", ("active", "recurrence", "relapse", "inactive", "remission", "resolved"))),
    ("condition", "verification_status", _in("verification_status", ("unconfirmed", "provisional", "differential", "confirmed", "refuted", "entered-in-error"))),
    ("condition", "abatement", "abatement_datetime >= onset_datetime"),
    ("observation", "status", _in("status", OBSERVATION_STATUS, False)),
    ("observation", "unit", "value_quantity is null or value_unit is not null"),
    ("procedure", "status", _in("status", PROCEDURE_STATUS, False)),
    ("procedure", "period", "performed_end >= performed_start"),
    ("medication_request", "status", _in("status", MEDICATION_STATUS, False)),
    ("medication_request", "intent", _in("intent", MEDICATION_INTENT, False)),
    ("medication_request", "choice", "(code_concept_id is null) != (medication_reference_id is null)"),
    ("dw.patient", "effective", "effective_to >= effective_from"),
    ("dw.patient", "current_open", "is_current = (effective_to = date '9999-12-31')"),
    ("dw.encounter_type", "setting", _in("care_setting", ("Inpatient", "Emergency", "Ambulatory", "Virtual", "Home", "Other", "Unknown"), False)),
    ("fact.encounter", "stay", "length_of_stay_days >= 0"),
]

#: Fixed values: (child table, column, parent table, key).
FOREIGN_KEYS = [
    ("raw.document", "batch_id", "meta.load_batch", "batch_id"), ("stg.rejects", "batch_id", "meta.load_batch", "batch_id"),
    ("code_concept", "code_system_id", "code_system", "code_system_id"), ("organization", "type_code_concept_id", "code_concept", "code_concept_id"),
    ("practitioner_identifier", "practitioner_id", "practitioner", "practitioner_id"), ("organization_identifier", "organization_id", "organization", "organization_id"), ("patient_address", "patient_id", "patient", "patient_id"),
    ("encounter", "patient_id", "patient", "patient_id"), ("encounter", "service_provider_id", "organization", "organization_id"), ("encounter", "primary_performer_id", "practitioner", "practitioner_id"), ("encounter", "type_code_concept_id", "code_concept", "code_concept_id"),
    *((t, c, p, k) for t in ("condition", "observation", "procedure", "medication_request") for c, p, k in (("patient_id", "patient", "patient_id"), ("encounter_id", "encounter", "encounter_id"), ("code_concept_id", "code_concept", "code_concept_id"))),
    ("medication_request", "requester_id", "practitioner", "practitioner_id"), ("observation_component", "observation_id", "observation", "observation_id"), ("observation_component", "code_concept_id", "code_concept", "code_concept_id"), ("resource_coding", "code_concept_id", "code_concept", "code_concept_id"),
    ("fact.encounter", "patient_key", "dw.patient", "patient_key"), ("fact.encounter", "provider_key", "dw.provider", "provider_key"), ("fact.encounter", "organization_key", "dw.organization", "organization_key"), ("fact.encounter", "encounter_type_key", "dw.encounter_type", "encounter_type_key"), ("fact.encounter", "start_date_key", "dw.date", "date_key"), ("fact.encounter", "end_date_key", "dw.date", "date_key"),
    ("fact.observation", "patient_key", "dw.patient", "patient_key"), ("fact.observation", "encounter_id", "fact.encounter", "encounter_id"), ("fact.observation", "observation_code_key", "dw.observation_code", "observation_code_key"), ("fact.observation", "effective_date_key", "dw.date", "date_key"),
    ("fact.medication_order", "patient_key", "dw.patient", "patient_key"), ("fact.medication_order", "encounter_id", "fact.encounter", "encounter_id"), ("fact.medication_order", "provider_key", "dw.provider", "provider_key"), ("fact.medication_order", "medication_key", "dw.medication", "medication_key"), ("fact.medication_order", "authored_date_key", "dw.date", "date_key"),
    ("fact.encounter_diagnosis", "encounter_id", "fact.encounter", "encounter_id"), ("fact.encounter_diagnosis", "patient_key", "dw.patient", "patient_key"), ("fact.encounter_diagnosis", "diagnosis_key", "dw.diagnosis", "diagnosis_key"), ("fact.encounter_diagnosis", "onset_date_key", "dw.date", "date_key"),
    ("fact.procedure", "patient_key", "dw.patient", "patient_key"), ("fact.procedure", "encounter_id", "fact.encounter", "encounter_id"), ("fact.procedure", "procedure_key", "dw.procedure", "procedure_key"), ("fact.procedure", "performed_date_key", "dw.date", "date_key"),
]

#: Natural keys.
KEYS = {
    "code_system": ["system_uri"], "code_concept": ["code_system_id", "code"], "patient": ["patient_id"], "patient_address": ["patient_id", "address_seq"], "encounter": ["encounter_id"], "observation": ["observation_id"],
    "observation_component": ["observation_id", "component_seq"], "fact.encounter": ["encounter_id"], "fact.observation": ["observation_id", "component_seq"], "fact.medication_order": ["medication_request_id"],
    "fact.encounter_diagnosis": ["condition_id"], "fact.procedure": ["procedure_id"], "dw.patient": ["patient_id", "version_number"], "dw.provider": ["practitioner_id"], "dw.organization": ["organization_id"],
}

_ROW = "constraint_name string, table_name string, n_rows long"


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _said(parts: list[DataFrame], tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union(parts) if parts else next(iter(tables.values())).sparkSession.createDataFrame([], _ROW)


def check_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(constraint_name, table_name, n_rows) of each check that rows break: one pass over each table counts all its checks."""
    parts = []
    for name in dict.fromkeys(t for t, _, _ in CHECKS if t in tables):
        own = [(n, p) for t, n, p in CHECKS if t == name]
        row = tables[name].agg(*(F.count_if(~F.coalesce(F.expr(p), F.lit(True))).alias(n) for n, p in own))
        parts.append(row.unpivot([], [n for n, _ in own], "constraint_name", "n_rows").withColumn("table_name", F.lit(name)).where("n_rows > 0").select("constraint_name", "table_name", "n_rows"))
    return _said(parts, tables)


def foreign_key_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Foreign keys whose parent is missing, with the rows concerned."""
    parts = []
    for child, column, parent, key in FOREIGN_KEYS:
        if child in tables and parent in tables:
            n = orphans(tables[child], column, tables[parent], key).agg(F.count("*").alias("n_rows"))
            parts.append(n.where("n_rows > 0").select(F.lit(f"{column} -> {parent}").alias("constraint_name"), F.lit(child).alias("table_name"), "n_rows"))
    return _said(parts, tables)


def natural_key_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Natural keys that repeat, with the rows concerned."""
    parts = []
    for name, keys in KEYS.items():
        if name in tables:
            n = duplicates(tables[name], keys).agg(F.count("*").alias("n_rows"))
            parts.append(n.where("n_rows > 0").select(F.lit(f"unique ({', '.join(keys)})").alias("constraint_name"), F.lit(name).alias("table_name"), "n_rows"))
    return _said(parts, tables)


def key_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Foreign keys whose parent is missing and natural keys that repeat, with the rows concerned."""
    return foreign_key_violations(tables).unionByName(natural_key_violations(tables))


def catalog(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(table, column, type, constraints) of every column, for documents about the schema."""
    out = []
    for name, df in tables.items():
        for column, kind in df.dtypes:
            said = [f"references {p}.{k}" for t, c, p, k in FOREIGN_KEYS if (t, c) == (name, column)] + (["key"] if column in KEYS.get(name, []) else [])
            out.append((name, column, kind, ", ".join(said)))
    return out
