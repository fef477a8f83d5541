"""Small documents by rule, planted defects and change feeds: inputs of tests and benchmarks."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defect classes, the type they are planted in, and what the reason must hold.
DEFECTS = {
    "malformed_json": ("Observation", "not valid JSON"), "missing_required_status": ("Observation", "status"), "code_outside_value_set": ("Patient", "value set"), "medication_choice_both_branches": ("MedicationRequest", "medication[x]"),
    "coding_absent": ("Condition", "coding"), "unmodelled_resource_type": ("Procedure", "not modelled"), "malformed_id": ("Encounter", "valid FHIR id"), "organization_without_name": ("Organization", "org-1"),
}
LOINC, SNOMED, RXNORM = "http://loinc.org", "http://snomed.info/sct", "http://www.nlm.nih.gov/research/umls/rxnorm"


def concept(system: str, code: str, display: str | None = None) -> dict:
    return {"coding": [{"system": system, "code": code} | ({"display": display} if display else {})]}


def extract(patients: int = 20) -> dict[str, list[dict]]:
    """Documents of all types for some patients, the same each time."""
    meta = {"versionId": "1", "lastUpdated": "2026-07-01T00:00:00Z"}
    docs: dict[str, list[dict]] = {k: [] for k in ("Organization", "Practitioner", "Patient", "Encounter", "Condition", "Observation", "Procedure", "MedicationRequest")}
    for i in range(3):
        docs["Organization"].append({"resourceType": "Organization", "id": f"org{i}", "meta": meta, "name": f"Clinic {i}", "active": True, "type": [concept("http://terminology.hl7.org/CodeSystem/organization-type", "prov", "Healthcare Provider")], "identifier": [{"system": "urn:org", "value": f"O{i}"}]})
        docs["Practitioner"].append({"resourceType": "Practitioner", "id": f"prac{i}", "meta": meta, "name": [{"family": f"Doctor{i}", "given": ["Ann"]}], "gender": "female", "active": True, "identifier": [{"system": "http://hl7.org/fhir/sid/us-npi", "value": f"99{i}"}]})
    for i in range(patients):
        docs["Patient"].append({"resourceType": "Patient", "id": f"p{i}", "meta": meta, "name": [{"family": f"Family{i}", "given": [f"Given{i}"]}], "gender": ["male", "female"][i % 2], "birthDate": f"{1940 + 3 * i % 70}-0{1 + i % 9}-11", "maritalStatus": concept("http://terminology.hl7.org/CodeSystem/v3-MaritalStatus", "MS"[i % 2]), "address": [{"line": ["1 Road"], "city": f"City{i % 4}", "state": "ON", "postalCode": f"A{i}"}, {"city": "Old town", "state": "ON"}][: 1 + i % 2]})
        for k in range(4):
            start = datetime(2025, 1, 1) + timedelta(days=i + [0, 20, 90, 120][k])
            inpatient = k < 2
            e = {"resourceType": "Encounter", "id": f"p{i}-e{k}", "meta": meta, "status": "finished", "class": {"system": "http://terminology.hl7.org/CodeSystem/v3-ActCode", "code": "IMP" if inpatient else ["AMB", "EMER"][k % 2]}, "type": [concept(SNOMED, f"30834700{k}", f"Visit kind {k}")], "subject": {"reference": f"Patient/p{i}"},
                 "participant": [{"individual": {"reference": "Practitioner?identifier=http://hl7.org/fhir/sid/us-npi|990"}}, {"individual": {"reference": f"Practitioner/prac{1 + i % 2}"}, "type": [concept("http://terminology.hl7.org/CodeSystem/v3-ParticipationType", "PPRF")]}],
                 "period": {"start": start.isoformat() + "Z"} | ({} if k == 3 and i % 5 == 0 else {"end": (start + timedelta(days=2 if inpatient else 0, minutes=30)).isoformat() + "Z"}), "serviceProvider": {"reference": f"Organization?identifier=urn:org|O{i % 3}"}}
            docs["Encounter"].append(e)
            docs["Condition"].append({"resourceType": "Condition", "id": f"p{i}-c{k}", "meta": meta, "subject": {"reference": f"Patient/p{i}"}, "encounter": {"reference": f"Encounter/p{i}-e{k}"}, "code": concept(SNOMED, ["44054006", "38341003", "195662009", "10509002"][k], ["Diabetes mellitus type 2", "Hypertension", "Acute pharyngitis", "Acute bronchitis"][k]), "clinicalStatus": concept("http://terminology.hl7.org/CodeSystem/condition-clinical", "active"), "onsetDateTime": start.isoformat() + "Z", "recordedDate": start.isoformat() + "Z"})
            obs = {"resourceType": "Observation", "status": "final", "meta": meta, "subject": {"reference": f"Patient/p{i}"}, "encounter": {"reference": f"Encounter/p{i}-e{k}"}, "effectiveDateTime": start.isoformat() + "Z", "issued": start.isoformat() + "Z"}
            docs["Observation"].append(obs | {"id": f"p{i}-o{k}a", "code": {"coding": [{"system": SNOMED, "code": "33747003"}, {"system": LOINC, "code": "2339-0", "display": "Glucose"}]}, "valueQuantity": {"value": 80 + (7 * i + k) % 40, "unit": "mg/dL"}})
            docs["Observation"].append(obs | {"id": f"p{i}-o{k}b", "code": concept(LOINC, "85354-9", "Blood pressure"), "component": [{"code": concept(LOINC, "8480-6", "Systolic"), "valueQuantity": {"value": 120 + k, "unit": "mm[Hg]"}}, {"code": concept(LOINC, "8462-4", "Diastolic"), "valueQuantity": {"value": 1.2607e-06, "unit": "mm[Hg]"}}]})
            docs["Procedure"].append({"resourceType": "Procedure", "id": f"p{i}-r{k}", "meta": meta, "status": "completed", "code": concept(SNOMED, "430193006", "Medication reconciliation"), "subject": {"reference": f"Patient/p{i}"}, "encounter": {"reference": f"Encounter/p{i}-e{k}"}, "performedPeriod": {"start": start.isoformat() + "Z", "end": (start + timedelta(minutes=45)).isoformat() + "Z"}})
            docs["MedicationRequest"].append({"resourceType": "MedicationRequest", "id": f"p{i}-m{k}", "meta": meta, "status": "active", "intent": "order", "subject": {"reference": f"Patient/p{i}"}, "encounter": {"reference": f"Encounter/p{i}-e{k}"}, "authoredOn": start.isoformat() + "Z", "requester": {"reference": "Practitioner?identifier=http://hl7.org/fhir/sid/us-npi|990"}, "medicationCodeableConcept": concept(RXNORM, "860975", "Metformin 500 MG")})
    return docs


def with_defects(docs: dict[str, list[dict]], per_class: int = 3) -> tuple[dict[str, list[str]], list[dict]]:
    """Lines of each type with planted defects at positions that don't overlap, and the manifest of what was planted where."""
    lines = {k: [json.dumps(d) for d in v] for k, v in docs.items()}
    manifest = []
    for c, (kind, (where, fragment)) in enumerate(DEFECTS.items()):
        n = len(docs[where])
        for k in range(min(per_class, n)):
            at = (c + k * max(1, n // per_class)) % n
            d = json.loads(json.dumps(docs[where][at]))
            text = None
            if kind == "malformed_json":
                text = lines[where][at][:40]
            elif kind == "missing_required_status":
                del d["status"]
            elif kind == "code_outside_value_set":
                d["gender"] = "sometimes"
            elif kind == "medication_choice_both_branches":
                d["medicationReference"] = {"reference": "Medication/1"}
            elif kind == "coding_absent":
                d["code"] = {"text": "none"}
            elif kind == "unmodelled_resource_type":
                d["resourceType"] = "Spaceship"
            elif kind == "malformed_id":
                d["id"] = "not an id!"
            else:
                del d["name"]
            lines[where][at] = text or json.dumps(d)
            manifest.append({"resource_type": where, "resource_id": docs[where][at]["id"], "line_number": at + 1, "defect_class": kind, "expected_reason_fragment": fragment})
    return lines, manifest


def inject(rows: DataFrame, every: int) -> DataFrame:
    """Read rows (sources.documents) of which each n-th by its place is made faulty: cut off, without a valid id, or of an unknown type."""
    place = F.pmod(F.xxhash64("source_ref", "line_number"), F.lit(3 * every))
    bad = {0: F.lit(None).cast("string"), 1: F.regexp_replace("payload", r'"id"\s*:\s*"', '"id": "not an id! '), 2: F.regexp_replace("payload", r'"resourceType"\s*:\s*"', '"resourceType": "Space')}
    cut = (place == 0) & F.col("payload").isNotNull()
    payload = F.when(cut, bad[0]).when(place == 1, bad[1]).when(place == 2, bad[2]).otherwise(F.col("payload"))
    return rows.withColumns({"payload": payload, "parse_error": F.when(cut, "not valid JSON: injected truncation").otherwise(F.col("parse_error")), "raw_text": F.when(cut, F.left("payload", F.lit(40))).otherwise(F.col("raw_text"))})


def write_lines(lines: dict[str, list[str]], folder: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for kind, rows in lines.items():
        Path(folder, f"{kind}.ndjson").write_text("\n".join(rows) + "\n")
    return folder


def change_feed(docs: dict[str, list[dict]], every: int = 7, day: str = "2026-08-03") -> tuple[list[dict], list[dict]]:
    """New versions of every n-th patient (address, marital status or both, in turn) and the manifest."""
    changed, manifest = [], []
    for k, p in enumerate(docs["Patient"][::every]):
        kind = ("address", "marital", "both")[k % 3]
        new = json.loads(json.dumps(p))
        new["meta"] = {"versionId": "2", "lastUpdated": f"{day}T00:00:00Z"}
        if kind != "marital":
            new["address"][0]["city"] = "New town"
        if kind != "address":
            new["maritalStatus"] = concept("http://terminology.hl7.org/CodeSystem/v3-MaritalStatus", "W")
        changed.append(new)
        manifest.append({"patient_id": p["id"], "new_version_id": "2", "change_date": day, "change_kind": kind})
    return changed, manifest
