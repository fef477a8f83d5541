"""Validation of documents by ordered rules: the first that fails gives stage and reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled
from ..sources.schemas import GATE, RESOURCE_TYPES

#: The value sets of the gate.
GENDERS = ("male", "female", "other", "unknown")
ENCOUNTER_STATUS = ("planned", "arrived", "triaged", "in-progress", "onleave", "finished", "cancelled", "entered-in-error", "unknown")
OBSERVATION_STATUS = ("registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown")
PROCEDURE_STATUS = ("preparation", "in-progress", "not-done", "on-hold", "stopped", "completed", "entered-in-error", "unknown")
MEDICATION_STATUS = ("active", "on-hold", "cancelled", "completed", "entered-in-error", "stopped", "draft", "unknown")
MEDICATION_INTENT = ("proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option")
REASON_CHARS, PAYLOAD_CHARS = 400, 8000

Rule = tuple[str, Column, str]


def first_failure(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(failure_stage, reason) columns of the first rule whose condition holds; null conditions don't."""
    stage = reason = None
    for s, fails, why in rules:
        fails = F.coalesce(fails, F.lit(False))
        stage = F.when(fails, s) if stage is None else stage.when(fails, s)
        reason = F.when(fails, why) if reason is None else reason.when(fails, why)
    return stage.alias("failure_stage"), reason.alias("reason")


def verdict(rules: Sequence[Rule]) -> Column:
    """first_failure() as one struct, for which each condition is evaluated once."""
    out = None
    for s, fails, why in rules:
        said = F.struct(F.lit(s).alias("failure_stage"), F.lit(why).alias("reason"))
        out = F.when(fails, said) if out is None else out.when(fails, said)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("failure_stage"), F.lit(None).cast("string").alias("reason")))


def document_rules(error: Column, g: Column) -> list[Rule]:
    """The rules for parsed gate fields g (schemas.GATE), in order: reading, envelope, then each type's own."""
    kind = g["resourceType"]
    of = lambda *types: kind.isin(*types)
    no_coding = F.coalesce(F.size(g["code"]["coding"]), F.lit(0)) <= 0
    bare = lambda q: q["value"].isNotNull() & filled(q["unit"]).isNull() & filled(q["code"]).isNull()
    odd = lambda c, values: c.isNotNull() & ~c.isin(*values)
    both = g["medicationCodeableConcept"].isNotNull().cast("int") + g["medicationReference"].isNotNull().cast("int")
    status = {"Encounter": ENCOUNTER_STATUS, "Observation": OBSERVATION_STATUS, "Procedure": PROCEDURE_STATUS, "MedicationRequest": MEDICATION_STATUS}
    rules: list[Rule] = [
        ("parse", error.isNotNull(), "document: not valid JSON"),
        ("schema", kind.isNull(), "resourceType: missing"),
        ("schema", ~of(*RESOURCE_TYPES), "resourceType: not modelled"),
        ("schema", g["id"].isNull() | ~g["id"].rlike(r"^[A-Za-z0-9\-.]{1,64}$"), "id: not a valid FHIR id"),
        ("schema", of("Patient", "Practitioner") & odd(g["gender"], GENDERS), "gender: outside the value set"),
        ("constraint", of("Organization") & filled(g["name"]).isNull(), "name: org-1 asks for a name"),
        *(("schema", of(t) & g["status"].isNull(), "status: required") for t in status),
        *(("schema", of(t) & odd(g["status"], values), "status: outside the value set") for t, values in status.items()),
        ("schema", of("Encounter") & g["class"].isNull(), "class: required"),
        ("schema", of("Condition", "Procedure", "MedicationRequest") & g["subject"].isNull(), "subject: required"),
        ("schema", of("Condition", "Observation", "Procedure") & no_coding, "code: no coding"),
        ("constraint", of("Observation") & bare(g["valueQuantity"]), "valueQuantity: needs unit or code"),
        ("constraint", of("Observation") & F.exists(g["component"], lambda c: F.coalesce(bare(c["valueQuantity"]), F.lit(False))), "component.valueQuantity: needs unit or code"),
        ("schema", of("MedicationRequest") & g["intent"].isNull(), "intent: required"),
        ("schema", of("MedicationRequest") & odd(g["intent"], MEDICATION_INTENT), "intent: outside the value set"),
        ("constraint", of("MedicationRequest") & (both != 1), "medication[x]: exactly one of two branches"),
    ]
    return rules


def judged(rows: DataFrame) -> DataFrame:
    """Read rows (sources.documents) with resource_type, resource_id, version_id (`1` if absent), last_updated, failure_stage and reason; the
    last two are null where no rule fails. Each document is parsed once: the verdict is generated from the parsed fields, so that filters
    on it are not pushed below it, where they would parse the document again for each rule."""
    g = rows.withColumn("_g", F.from_json("payload", GATE))
    g = g.select("*", F.inline(F.array(verdict(document_rules(F.col("parse_error"), F.col("_g"))))))
    return g.select(
        F.col("_g.resourceType").alias("resource_type"), F.col("_g.id").alias("resource_id"), F.coalesce(filled(F.col("_g.meta.versionId")), F.lit("1")).alias("version_id"),
        F.date_trunc("MILLISECOND", F.try_to_timestamp(F.col("_g.meta.lastUpdated"))).cast("timestamp_ntz").alias("last_updated"), "failure_stage", "reason", *rows.columns,
    )


def divided(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of judged rows, see validate."""
    accepted = g.where("failure_stage is null").select("resource_type", "resource_id", "version_id", "last_updated", "payload", "source_ref", "line_number")
    rejected = g.where("failure_stage is not null").select(
        "resource_type", F.left("resource_id", F.lit(64)).alias("resource_id"), "source_ref", "line_number", "failure_stage",
        F.left(F.col("reason"), F.lit(REASON_CHARS)).alias("reason"), F.col("parse_error").alias("detail"), F.left(F.coalesce("payload", "raw_text"), F.lit(PAYLOAD_CHARS)).alias("payload"),
    )
    return accepted, rejected


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of read rows (sources.documents). Where both are needed, write judged(rows) and take divided() of that.

    accepted: resource_type, resource_id, version_id (`1` if absent), last_updated, payload, source_ref, line_number.
    rejected: resource_type, resource_id, source_ref, line_number, failure_stage, reason, detail, payload (both cut to size).
    """
    return divided(judged(rows))


def reason_slug(reason: Column) -> Column:
    """A stable key for a reason: its path and first words."""
    return F.regexp_replace(F.lower(F.regexp_replace(reason, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def reject_summary(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("failure_stage", F.coalesce("resource_type", F.lit("(unparsed)")).alias("resource_type"), "reason").agg(F.count("*").alias("n"), F.min("source_ref").alias("first_ref"), F.max("source_ref").alias("last_ref"))
