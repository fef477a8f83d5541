"""Documents to normalized tables. A document is parsed once, with its type's schema; arrays explode with their position."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..sources.schemas import RESOURCE_TYPES, SCHEMAS
from . import skew
from .tables import OnDemand, first_by, latest_version, upsert, with_keys

Tables = Mapping[str, DataFrame]

#: Fixed values.
NPI = "http://hl7.org/fhir/sid/us-npi"
LOINC, SNOMED, RXNORM = "http://loinc.org", "http://snomed.info/sct", "http://www.nlm.nih.gov/research/umls/rxnorm"
#: Known code systems, their names, and whether their content is licensed.
SYSTEMS = {
    "http://loinc.org": ("LOINC", True), "http://snomed.info/sct": ("SNOMED CT", True), "http://www.nlm.nih.gov/research/umls/rxnorm": ("RxNorm", False), "http://hl7.org/fhir/sid/icd-10-ca": ("ICD-10-CA", True),
    "http://terminology.hl7.org/CodeSystem/v3-ActCode": ("HL7 v3 ActCode", False), "http://terminology.hl7.org/CodeSystem/v3-MaritalStatus": ("HL7 v3 MaritalStatus", False), "http://unitsofmeasure.org": ("UCUM", False),
}
EXPECTED_SYSTEM = {"Condition": SNOMED, "Observation": LOINC, "MedicationRequest": RXNORM, "Procedure": SNOMED}


def current_version(raw: DataFrame) -> DataFrame:
    """The latest version of each document."""
    return latest_version(raw, ["resource_type", "resource_id"], "last_updated", "version_id")


def parsed(current: DataFrame, kind: str, *elements: str) -> DataFrame:
    """(resource_id, d): the documents of one type, parsed (of them the given elements only, if any); a filter on resource_type prunes
    partitions of a landed table. The parsed fields are generated, so that a document is parsed once and not for each field that is taken."""
    schema = StructType.fromDDL(SCHEMAS[kind])
    schema = StructType([f for f in schema if f.name in elements or not elements])
    return current.where(F.col("resource_type") == kind).select("resource_id", F.explode(F.array(F.from_json("payload", schema))).alias("d"))


def _code_of(coding: Column) -> list[Column]:
    return [coding["system"].alias("system"), coding["code"].alias("code"), C.filled(coding["display"]).alias("display")]


def codings(current: DataFrame) -> DataFrame:
    """(resource_type, resource_id, element, coding_seq from 1, system, code, display) of every coding in every document: each
    type's codings are one array, exploded once."""
    concepts = {
        "Patient": {"maritalStatus": "d.maritalStatus.coding"}, "Organization": {"type": "flatten(transform(coalesce(d.type, array()), x -> coalesce(x.coding, array())))"},
        "Encounter": {"class": "array(struct(d.class.system, d.class.code, d.class.display))", "type": "flatten(transform(coalesce(d.type, array()), x -> coalesce(x.coding, array())))"},
        "Condition": {"code": "d.code.coding"}, "Procedure": {"code": "d.code.coding"}, "MedicationRequest": {"code": "d.medicationCodeableConcept.coding"},
        "Observation": {"code": "d.code.coding", "value": "d.valueCodeableConcept.coding", "component": "flatten(transform(coalesce(d.component, array()), x -> concat(coalesce(x.code.coding, array()), coalesce(x.valueCodeableConcept.coding, array()))))"},
    }
    out = None
    for kind, elements in concepts.items():
        d = parsed(current, kind, *re.findall(r"\bd\.(\w+)", " ".join(elements.values())))
        one = [F.expr(f"transform(coalesce({e}, array()), (c, i) -> struct('{name}' as element, i + 1 as coding_seq, c.system as system, c.code as code, c.display as display))") for name, e in elements.items()]
        rows = d.select(F.lit(kind).alias("resource_type"), "resource_id", F.inline(F.concat(*one)))
        out = rows if out is None else out.unionByName(rows)
    return out.where("system is not null and code is not null").withColumn("display", C.filled(F.col("display")))


def register_codes(systems: DataFrame, concepts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two terminology tables with new systems and codes added; a display is only filled where there was none.

    systems: code_system_id, system_uri. concepts: code_concept_id, code_system_id, code, display. found: system, code, display.
    """
    new = distinct_codes(found)
    s = register_systems(systems, new)
    return s, register_concepts(concepts, s, new)


def distinct_codes(found: DataFrame) -> DataFrame:
    """(system, code, display): each code once."""
    return found.groupBy("system", "code").agg(F.min("display").alias("display"))


def register_systems(systems: DataFrame, new: DataFrame) -> DataFrame:
    """new: distinct_codes()."""
    s = upsert(systems, new.select(F.col("system").alias("system_uri")).distinct(), ["system_uri"], None)
    return with_keys(s, "code_system_id", ["system_uri"])


def register_concepts(concepts: DataFrame, systems: DataFrame, new: DataFrame) -> DataFrame:
    """systems: with those of new; new: distinct_codes()."""
    rows = new.join(systems.withColumnRenamed("system_uri", "system"), "system").select("code_system_id", "code", "display")
    c = upsert(concepts, rows, ["code_system_id", "code"], "t.display is null and s.display is not null")
    return with_keys(c, "code_concept_id", ["code_system_id", "code"])


def empty_terminology(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "code_system_id long, system_uri string, system_name string, is_licensed boolean"), spark.createDataFrame([], "code_concept_id long, code_system_id long, code string, display string")


def seeded(systems: DataFrame) -> DataFrame:
    """The code systems with the known ones' names, licensed or not; systems that documents bring are added as they are found."""
    known = systems.sparkSession.createDataFrame([(uri, *said) for uri, said in SYSTEMS.items()], "system_uri string, system_name string, is_licensed boolean")
    return with_keys(upsert(systems, known, ["system_uri"]), "code_system_id", ["system_uri"])


def code_view(systems: DataFrame, concepts: DataFrame) -> DataFrame:
    return concepts.join(systems, "code_system_id").select("code_concept_id", F.col("system_uri").alias("system"), "code", "display")


def identifiers(current: DataFrame, kind: str, owner: str) -> DataFrame:
    """(identifier_system, identifier_value, owner id); a shared identifier belongs to the least owner."""
    rows = parsed(current, kind, "identifier").select(F.col("resource_id").alias(owner), F.inline("d.identifier")).where("system is not null and value is not null")
    return rows.groupBy(F.col("system").alias("identifier_system"), F.col("value").alias("identifier_value")).agg(F.min(owner).alias(owner))


def resolved(df: DataFrame, reference: str, known: DataFrame, owners: DataFrame, owner: str, out: str) -> DataFrame:
    """Adds the id that a reference means: literal ids that exist, or the owner of the identifier of a conditional reference. Sides of a
    counted size are broadcast; else references that very many rows make (a clinic's one provider) are spread (operators.skew)."""
    system, value = C.conditional_reference(F.col(reference))
    df = df.withColumn("_lit", C.literal_reference(F.col(reference))).withColumn("_sys", system).withColumn("_val", value)
    df = skew.lookup(df, known.select(F.col(owner).alias("_lit"), F.col(owner).alias("_known")), ["_lit"])
    df = skew.lookup(df, owners.select(F.col("identifier_system").alias("_sys"), F.col("identifier_value").alias("_val"), F.col(owner).alias("_owner")), ["_sys", "_val"])
    return df.withColumn(out, F.coalesce("_known", "_owner")).drop("_lit", "_sys", "_val", "_known", "_owner")


def _coded(df: DataFrame, code: DataFrame, system: str, value: str, out: str) -> DataFrame:
    c = code.select(F.col("system").alias("_cs"), F.col("code").alias("_cc"), F.col("code_concept_id").alias(out))
    return df.join(c, (F.col(system) == F.col("_cs")) & (F.col(value) == F.col("_cc")), "left").drop("_cs", "_cc")


def preferred(coding: Column, system: str) -> Column:
    """The first coding of the given system, else the first."""
    return F.coalesce(F.get(F.filter(coding, lambda c: c["system"] == system), F.lit(0)), F.get(coding, F.lit(0)))


#: Normalized tables by name: each a function of the tables it needs (by name, `current` and `code` among them), so that one is made
#: without the others, and each is written once before others read it.
NORM: dict[str, Callable[[Tables], DataFrame]] = {}
_first = lambda c: F.get(c, F.lit(0))
_when = lambda c: C.instant(F.col(c))


def _norm(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    NORM[f.__name__] = f
    return f


@_norm
def organization(t: Tables) -> DataFrame:
    o = parsed(t["current"], "Organization").withColumn("_c", _first(_first(F.col("d.type"))["coding"])).withColumn("_a", _first(F.col("d.address")))
    o = _coded(o.withColumn("_sys", F.col("_c.system")).withColumn("_code", F.col("_c.code")), t["code"], "_sys", "_code", "type_code_concept_id")
    return o.select(F.col("resource_id").alias("organization_id"), "d.name", F.coalesce("d.active", F.lit(True)).alias("active"), "type_code_concept_id", "_a.city", "_a.state", F.col("_a.postalCode").alias("postal_code"))


@_norm
def organization_identifier(t: Tables) -> DataFrame:
    return identifiers(t["current"], "Organization", "organization_id")


@_norm
def practitioner(t: Tables) -> DataFrame:
    p = parsed(t["current"], "Practitioner").withColumn("_n", _first(F.col("d.name")))
    return p.select(F.col("resource_id").alias("practitioner_id"), F.col("_n.family").alias("family_name"), _first(F.col("_n.given")).alias("given_name"), "d.gender", F.coalesce("d.active", F.lit(True)).alias("active"))


@_norm
def practitioner_identifier(t: Tables) -> DataFrame:
    return identifiers(t["current"], "Practitioner", "practitioner_id")


@_norm
def patient(t: Tables) -> DataFrame:
    p = parsed(t["current"], "Patient").withColumn("_n", _first(F.col("d.name")))
    return p.select(F.col("resource_id").alias("patient_id"), F.col("_n.family").alias("family_name"), _first(F.col("_n.given")).alias("given_name"), C.calendar_date(F.col("d.birthDate")).alias("birth_date"), "d.gender", _first(F.col("d.maritalStatus.coding"))["code"].alias("marital_status"), C.instant(F.col("d.deceasedDateTime")).alias("deceased_datetime"))


@_norm
def patient_address(t: Tables) -> DataFrame:
    a = parsed(t["current"], "Patient", "address").select(F.col("resource_id").alias("patient_id"), F.posexplode("d.address").alias("address_seq", "_a"))
    return a.select("patient_id", "address_seq", _first(F.col("_a.line")).alias("line"), "_a.city", "_a.state", F.col("_a.postalCode").alias("postal_code"), "_a.country")


def _patient_of(df: DataFrame) -> DataFrame:
    visit = C.literal_reference(F.col("d.encounter.reference")) if "encounter" in df.schema["d"].dataType.names else F.lit(None).cast("string")
    return df.withColumn("patient_id", C.literal_reference(F.col("d.subject.reference"))).withColumn("encounter_ref", visit)


@_norm
def encounter(t: Tables) -> DataFrame:
    e = _patient_of(parsed(t["current"], "Encounter"))
    performer = F.get(F.array_sort(F.transform(F.filter(F.col("d.participant"), lambda x: x["individual"]["reference"].isNotNull()), lambda x, i: F.struct(
        F.when(F.exists(x["type"], lambda y: F.exists(y["coding"], lambda z: z["code"] == "PPRF")), 0).otherwise(1).alias("rank"), i.alias("i"), x["individual"]["reference"].alias("ref")))), F.lit(0))["ref"]
    e = e.withColumn("_performer", performer).withColumn("_provider", F.col("d.serviceProvider.reference")).withColumn("_t", _first(_first(F.col("d.type"))["coding"]))
    e = resolved(e, "_performer", t["practitioner"], t["practitioner_identifier"], "practitioner_id", "primary_performer_id")
    e = resolved(e, "_provider", t["organization"], t["organization_identifier"], "organization_id", "service_provider_id")
    e = _coded(e.withColumn("_sys", F.col("_t.system")).withColumn("_code", F.col("_t.code")), t["code"], "_sys", "_code", "type_code_concept_id")
    e = e.select(F.col("resource_id").alias("encounter_id"), "patient_id", "service_provider_id", "primary_performer_id", "d.status", F.col("d.class.code").alias("class_code"), C.class_display(F.col("d.class.code"), F.col("d.class.display")).alias("class_display"),
        "type_code_concept_id", F.col("_t.code").alias("type_code"), F.col("_t.display").alias("type_display"), C.instant(F.col("d.period.start")).alias("period_start"), C.instant(F.col("d.period.end")).alias("period_end"))
    return e.join(t["patient"].select("patient_id"), "patient_id", "left_semi")


def _children(t: Tables, kind: str, key: str, coding: Column, **cols) -> DataFrame:
    rows = _patient_of(parsed(t["current"], kind)).withColumn("_c", coding)
    rows = _coded(rows.withColumn("_sys", F.col("_c.system")).withColumn("_code", F.col("_c.code")), t["code"], "_sys", "_code", "code_concept_id")
    rows = rows.select(F.col("resource_id").alias(key), "patient_id", "encounter_ref", "code_concept_id", *(v.alias(k) for k, v in cols.items()))
    known = t["encounter"].select(F.col("encounter_id").alias("_e"))
    rows = rows.join(t["patient"].select("patient_id"), "patient_id", "left_semi").join(known, F.col("encounter_ref") == F.col("_e"), "left")
    return rows.select(key, "patient_id", F.col("_e").alias("encounter_id"), "code_concept_id", *cols)


#: Child tables by type with what they are keyed by, and what a row needs; rows that lack it are in `unresolved`.
CHILDREN = {
    "condition": ("Condition", "condition_id", "code_concept_id is not null", "code: does not resolve"), "observation": ("Observation", "observation_id", "code_concept_id is not null", "code: does not resolve"),
    "procedure": ("Procedure", "procedure_id", "code_concept_id is not null", "code: does not resolve"),
    "medication_request": ("MedicationRequest", "medication_request_id", "code_concept_id is not null or medication_reference_id is not null", "medication[x]: neither branch resolves"),
}


def _child(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A child table: all rows of known patients as `<name>_found`, and of these what has a code."""
    name = f.__name__
    NORM[f"{name}_found"] = f
    NORM[name] = lambda t: t[f"{name}_found"].where(CHILDREN[name][2])
    return f


@_child
def condition(t: Tables) -> DataFrame:
    return _children(t, "Condition", "condition_id", _first(F.col("d.code.coding")), clinical_status=_first(F.col("d.clinicalStatus.coding"))["code"], verification_status=_first(F.col("d.verificationStatus.coding"))["code"],
        onset_datetime=_when("d.onsetDateTime"), abatement_datetime=_when("d.abatementDateTime"), recorded_date=_when("d.recordedDate"))


@_child
def observation(t: Tables) -> DataFrame:
    q = F.col("d.valueQuantity")
    return _children(t, "Observation", "observation_id", preferred(F.col("d.code.coding"), LOINC), status=F.col("d.status"), category=_first(_first(F.col("d.category"))["coding"])["code"], effective_datetime=_when("d.effectiveDateTime"),
        issued=_when("d.issued"), value_quantity=C.exact_decimal(q["value"]), value_unit=F.coalesce(q["unit"], q["code"]), value_string=F.col("d.valueString"), value_code=_first(F.col("d.valueCodeableConcept.coding"))["code"], has_components=F.col("d.component").isNotNull())


@_norm
def observation_component(t: Tables) -> DataFrame:
    """Of all results of known patients, also of those without a code."""
    part = parsed(t["current"], "Observation", "component").select(F.col("resource_id").alias("observation_id"), F.posexplode("d.component").alias("_i", "_p"))
    part = part.join(t["observation_found"].select("observation_id"), "observation_id", "left_semi")
    part = part.withColumn("_c", preferred(F.col("_p.code.coding"), LOINC)).withColumn("_sys", F.col("_c.system")).withColumn("_code", F.col("_c.code"))
    q = F.col("_p.valueQuantity")
    return _coded(part, t["code"], "_sys", "_code", "code_concept_id").select("observation_id", (F.col("_i") + 1).alias("component_seq"), "code_concept_id", C.exact_decimal(q["value"]).alias("value_quantity"), F.coalesce(q["unit"], q["code"]).alias("value_unit"), F.col("_p.valueString").alias("value_string"))


@_child
def procedure(t: Tables) -> DataFrame:
    return _children(t, "Procedure", "procedure_id", _first(F.col("d.code.coding")), status=F.col("d.status"), performed_start=F.coalesce(_when("d.performedDateTime"), _when("d.performedPeriod.start")), performed_end=F.coalesce(_when("d.performedPeriod.end"), _when("d.performedDateTime")))


@_child
def medication_request(t: Tables) -> DataFrame:
    m = _children(t, "MedicationRequest", "medication_request_id", _first(F.col("d.medicationCodeableConcept.coding")), status=F.col("d.status"), intent=F.col("d.intent"), authored_on=_when("d.authoredOn"), _requester=F.col("d.requester.reference"), _medication=C.literal_reference(F.col("d.medicationReference.reference")))
    m = resolved(m, "_requester", t["practitioner"], t["practitioner_identifier"], "practitioner_id", "requester_id")
    return m.withColumn("medication_reference_id", F.when(F.col("code_concept_id").isNull(), F.col("_medication"))).drop("_requester", "_medication")


@_norm
def unresolved(t: Tables) -> DataFrame:
    """(resource_type, resource_id, failure_stage, reason): current documents whose required parent or code does not resolve."""
    said = lambda df, kind, key, stage, why: df.select(F.lit(kind).alias("resource_type"), F.col(key).alias("resource_id"), F.lit(stage).alias("failure_stage"), F.lit(why).alias("reason"))
    out = [said(t[f"{name}_found"].where(f"not ({has})"), kind, key, "constraint", why) for name, (kind, key, has, why) in CHILDREN.items()]
    for name, kind, key in (("encounter", "Encounter", "encounter_id"), *((f"{n}_found", kind, key) for n, (kind, key, _, _) in CHILDREN.items())):
        lost = t["current"].where(F.col("resource_type") == kind).select("resource_id").join(t[name].select(F.col(key).alias("resource_id")), "resource_id", "left_anti")
        out.append(said(lost, kind, "resource_id", "reference", "subject: no such patient"))
    return reduce(DataFrame.unionByName, out)


@_norm
def resource_coding(t: Tables) -> DataFrame:
    rc = _coded(t["codings"], t["code"], "system", "code", "code_concept_id").where("code_concept_id is not null")
    expected = F.create_map(*(F.lit(x) for kv in EXPECTED_SYSTEM.items() for x in kv))
    return rc.select("resource_type", "resource_id", "element", "coding_seq", "code_concept_id", (F.col("system") == F.try_element_at(expected, F.col("resource_type"))).alias("is_primary"))


@_norm
def code(t: Tables) -> DataFrame:
    return code_view(t["code_system"], t["code_concept"])


def norm_tables(current: DataFrame, systems: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """All normalized tables of the current documents. Rows whose required parent or code does not resolve are left out here and
    are in `unresolved` (resource_type, resource_id, reason) instead."""
    given = {"current": current, "code_system": systems, "code_concept": concepts}
    t = OnDemand({n: lambda _, df=df: df for n, df in given.items()} | {"codings": lambda t: codings(t["current"])} | NORM)
    return {n: t[n] for n in NORM if not n.endswith("_found")}


def first_address(addresses: DataFrame) -> DataFrame:
    return first_by(addresses, ["patient_id"], F.col("address_seq"), ["city", "state", "postal_code"])
