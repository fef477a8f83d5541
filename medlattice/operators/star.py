"""The star: Type 1 dimensions, the Type 2 patient dimension, five facts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import history, measures
from .shred import NPI, Tables, first_address
from .tables import OnDemand, inferred, upsert, with_keys, with_unknown

TRACKED = ["marital_status", "city", "state", "postal_code"]
REFRESHED = ["birth_date", "gender", "age_band", "full_name"]


def _full_name() -> F.Column:
    return C.filled(F.concat_ws(" ", "given_name", "family_name"))


def patient_source(norm: Tables, as_of: str) -> DataFrame:
    """One row for each patient: tracked attributes (first address) and those that only refresh; the age band is of the day given."""
    p = norm["patient"].join(first_address(norm["patient_address"]), "patient_id", "left")
    return p.select("patient_id", *TRACKED, "birth_date", "gender", C.age_band(F.col("birth_date"), F.lit(as_of).cast("date")).alias("age_band"), _full_name().alias("full_name"))


def type1(dim: DataFrame | None, source: DataFrame, business: list[str], key: str) -> DataFrame:
    """A Type 1 dimension after a load: members keep their key, new ones are numbered; stubs that the source knows are filled."""
    source = source.withColumn("is_inferred", F.lit(False))
    if dim is None:
        dim = source.where(F.lit(False)).withColumn(key, F.lit(None).cast("long"))
    return with_keys(upsert(dim, source, business), key, business)


def dimension_makers(before: Mapping[str, DataFrame], effective: str) -> dict[str, Callable[[Tables], DataFrame]]:
    """The dimensions by name, each a function of the normalized tables: as they are after a load; before holds those of the last one
    (empty at first). Members that facts name but no document describes are inferred."""

    def provider(t: Tables) -> DataFrame:
        npi = t["practitioner_identifier"].where(F.col("identifier_system") == NPI).groupBy("practitioner_id").agg(F.min("identifier_value").alias("npi"))
        rows = t["practitioner"].join(npi, "practitioner_id", "left").select("practitioner_id", _full_name().alias("full_name"), "npi", "gender", "active")
        return type1(before.get("provider"), rows, ["practitioner_id"], "provider_key")

    def organization(t: Tables) -> DataFrame:
        org = t["organization"].join(t["code"].select(F.col("code_concept_id").alias("type_code_concept_id"), F.col("display").alias("type_display")), "type_code_concept_id", "left")
        return type1(before.get("organization"), org.select("organization_id", "name", "type_display", "city", "state"), ["organization_id"], "organization_key")

    def coded(name: str, *sources: str) -> Callable[[Tables], DataFrame]:
        def made(t: Tables) -> DataFrame:
            used = reduce(DataFrame.union, (t[s].select("code_concept_id") for s in sources)).distinct()
            rows = t["code"].join(used, "code_concept_id", "left_semi").select(F.col("system").alias("code_system"), "code", F.coalesce("display", "code").alias("display"))
            return type1(before.get(name), rows, ["code_system", "code"], f"{name}_key")

        return made

    def encounter_type(t: Tables) -> DataFrame:
        kinds = t["encounter"].select("class_code", F.coalesce("type_code", F.lit("")).alias("type_code"), "class_display", "type_display").groupBy("class_code", "type_code").agg(F.min("class_display").alias("class_display"), F.min("type_display").alias("type_display"))
        return type1(before.get("encounter_type"), kinds.withColumn("care_setting", C.care_setting(F.col("class_code"))), ["class_code", "type_code"], "encounter_type_key")

    def patient(t: Tables) -> DataFrame:
        source, old = patient_source(t, effective), before.get("patient")
        dim = history.empty_history(source, "patient_id", TRACKED, REFRESHED) if old is None else old.drop("patient_key")
        now = history.apply_scd2(dim, source, "patient_id", TRACKED, effective, REFRESHED)
        missing = t["encounter"].select("patient_id").distinct()
        now = inferred(now, missing, "patient_id", effective_from=C.FIRST_DAY, effective_to=C.OPEN_END, is_current=True, version_number=1, row_hash="")
        keyed = now.withColumn("patient_key", F.lit(None).cast("long")) if old is None else now.join(old.select("patient_id", "version_number", "patient_key"), ["patient_id", "version_number"], "left")
        return with_keys(keyed, "patient_key", ["patient_id", "version_number"])

    return {
        "provider": provider, "organization": organization, "diagnosis": coded("diagnosis", "condition"), "procedure": coded("procedure", "procedure"), "medication": coded("medication", "medication_request"),
        "observation_code": coded("observation_code", "observation", "observation_component"), "encounter_type": encounter_type, "date": lambda t: measures.calendar(t["code"].sparkSession), "patient": patient,
    }


def dimensions(norm: Tables, before: Mapping[str, DataFrame], effective: str) -> dict[str, DataFrame]:
    """All dimensions after a load, see dimension_makers."""
    return {name: make(norm) for name, make in dimension_makers(before, effective).items()}


def with_unknown_member(name: str, dim: DataFrame) -> DataFrame:
    """The dimension with its -1 row, as the views join it."""
    if name == "date":
        return dim
    more = {"effective_from": C.FIRST_DAY, "effective_to": C.OPEN_END, "is_current": True, "version_number": 1, "row_hash": ""} if name == "patient" else {}
    return with_unknown(dim, f"{name}_key", is_inferred=False, **more)


def unknown_members(dims: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The dimensions with their -1 rows."""
    return {name: with_unknown_member(name, df) for name, df in dims.items()}


def _lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], key: str, out: str | None = None) -> DataFrame:
    """Adds the dimension's key by its business key, -1 where there is none."""
    side = dim.select(*(F.col(b).alias(f"_dim_{b}") for b in on.values()), F.col(key).alias("_key"))
    cond = [F.col(a) == F.col(f"_dim_{b}") for a, b in on.items()]
    return df.join(side, cond, "left").withColumn(out or key, F.coalesce("_key", F.lit(-1)).cast("long")).drop("_key", *(f"_dim_{b}" for b in on.values()))


def _patient(df: DataFrame, t: Tables, at: str) -> DataFrame:
    out = history.as_of_join(df, t["dim.patient"], "patient_id", F.col(at).cast("date"), ["patient_key"])
    return out.withColumn("patient_key", F.coalesce("patient_key", F.lit(-1)).cast("long"))


def _day(c: str, known: tuple[str, str] = (C.FIRST_DAY, "2035-12-31")) -> F.Column:
    d = F.col(c).cast("date")
    return F.when(d.between(*known), C.date_key(d)).otherwise(-1).cast("int")


def _coded(df: DataFrame, t: Tables) -> DataFrame:
    return df.join(t["code"].select("code_concept_id", F.col("system").alias("_sys"), F.col("code").alias("_code")), "code_concept_id", "left")


def _visit(df: DataFrame, t: Tables) -> DataFrame:
    """Encounters that are no facts become null."""
    known = t["fact.encounter"].select(F.col("encounter_id").alias("_enc"))
    return df.join(known, F.col("encounter_id") == F.col("_enc"), "left").withColumn("encounter_id", F.col("_enc")).drop("_enc")


def fact_makers(batch_id: str) -> dict[str, Callable[[Tables], DataFrame]]:
    """The five facts by name, each a function of the normalized tables, the dimensions (`dim.<name>`) and fact.encounter. Patients are
    looked up at the fact's date, everything else by business key; what is missing is -1."""
    batch = F.lit(batch_id).alias("load_batch_id")

    def encounter(t: Tables) -> DataFrame:
        e = t["encounter"].withColumn("type_code", F.coalesce("type_code", F.lit("")))
        inpatient = F.col("class_code").isin(*C.INPATIENT)
        e = e.withColumn("is_inpatient", inpatient.cast("int")).withColumn("is_emergency", (F.col("class_code") == "EMER").cast("int"))
        stays = measures.returns(e.where("is_inpatient = 1"), "patient_id", F.col("period_start").cast("date"), F.col("period_end").cast("date"), "encounter_id")
        e = e.join(stays.select("encounter_id", F.col("is_return").alias("is_readmission"), F.col("days_since").alias("days_since_discharge")), "encounter_id", "left")
        e = _patient(e, t, "period_start")
        e = _lookup(e, t["dim.provider"], {"primary_performer_id": "practitioner_id"}, "provider_key")
        e = _lookup(e, t["dim.organization"], {"service_provider_id": "organization_id"}, "organization_key")
        e = _lookup(e, t["dim.encounter_type"], {"class_code": "class_code", "type_code": "type_code"}, "encounter_type_key")
        start, end = F.col("period_start"), F.col("period_end")
        return e.select("encounter_id", "patient_id", "patient_key", "provider_key", "organization_key", "encounter_type_key", _day("period_start").alias("start_date_key"), _day("period_end").alias("end_date_key"), "status",
            "is_inpatient", "is_emergency", F.coalesce("is_readmission", F.lit(0)).alias("is_readmission"), "days_since_discharge", C.stay_days(start, end).alias("length_of_stay_days"), C.minutes_by_boundary(start, end).alias("duration_minutes"), F.lit(1).alias("encounter_count"), batch)

    def observation(t: Tables) -> DataFrame:
        o = t["observation"]
        own = o.where("value_quantity is not null or value_string is not null or value_code is not null or not has_components").select("observation_id", F.lit(0).alias("component_seq"), "patient_id", "encounter_id", "code_concept_id", "effective_datetime", "value_quantity", "value_unit", F.coalesce("value_string", "value_code").alias("value_text"))
        parts = t["observation_component"].where("code_concept_id is not null").join(o.select("observation_id", "patient_id", "encounter_id", "effective_datetime"), "observation_id")
        parts = parts.select("observation_id", "component_seq", "patient_id", "encounter_id", "code_concept_id", "effective_datetime", "value_quantity", "value_unit", F.col("value_string").alias("value_text"))
        r = _lookup(_coded(_visit(_patient(own.unionByName(parts), t, "effective_datetime"), t), t), t["dim.observation_code"], {"_sys": "code_system", "_code": "code"}, "observation_code_key")
        return r.select("observation_id", "component_seq", "patient_id", "patient_key", "encounter_id", "observation_code_key", _day("effective_datetime").alias("effective_date_key"), "value_quantity", "value_unit", "value_text", F.col("value_quantity").isNotNull().cast("int").alias("is_numeric"), F.lit(1).alias("result_count"), batch)

    def medication_order(t: Tables) -> DataFrame:
        m = _lookup(_coded(_visit(_patient(t["medication_request"], t, "authored_on"), t), t), t["dim.medication"], {"_sys": "code_system", "_code": "code"}, "medication_key")
        m = _lookup(m, t["dim.provider"], {"requester_id": "practitioner_id"}, "provider_key")
        return m.select("medication_request_id", "patient_id", "patient_key", "encounter_id", "provider_key", "medication_key", _day("authored_on").alias("authored_date_key"), "status", "intent", F.lit(1).alias("order_count"), batch)

    def encounter_diagnosis(t: Tables) -> DataFrame:
        c = t["condition"].withColumn("_at", F.coalesce("onset_datetime", "recorded_date")).withColumnRenamed("_at", "at")
        c = _lookup(_coded(_visit(_patient(c, t, "at"), t), t), t["dim.diagnosis"], {"_sys": "code_system", "_code": "code"}, "diagnosis_key")
        return c.select("condition_id", "patient_id", "patient_key", "encounter_id", "diagnosis_key", _day("at").alias("onset_date_key"), "clinical_status", F.lit(1).alias("diagnosis_count"), batch)

    def procedure(t: Tables) -> DataFrame:
        p = _lookup(_coded(_visit(_patient(t["procedure"], t, "performed_start"), t), t), t["dim.procedure"], {"_sys": "code_system", "_code": "code"}, "procedure_key")
        return p.select("procedure_id", "patient_id", "patient_key", "encounter_id", "procedure_key", _day("performed_start").alias("performed_date_key"), C.minutes_by_boundary(F.col("performed_start"), F.col("performed_end")).alias("duration_minutes"), F.lit(1).alias("procedure_count"), batch)

    return {"encounter": encounter, "observation": observation, "medication_order": medication_order, "encounter_diagnosis": encounter_diagnosis, "procedure": procedure}


def facts(norm: Tables, dims: dict[str, DataFrame], batch_id: str) -> dict[str, DataFrame]:
    """The five facts, see fact_makers."""
    makers = fact_makers(batch_id)
    given = dict(norm) | {f"dim.{n}": df for n, df in dims.items()}
    t = OnDemand({n: lambda _, df=df: df for n, df in given.items()} | {f"fact.{n}": make for n, make in makers.items()})
    return {n: t[f"fact.{n}"] for n in makers}
