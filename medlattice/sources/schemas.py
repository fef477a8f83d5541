"""One explicit schema for each document type; nothing is inferred. Elements that are not named stay in the raw payload."""

from __future__ import annotations

#: The modelled document types, parents before children.
RESOURCE_TYPES = ("Organization", "Practitioner", "Patient", "Encounter", "Condition", "Observation", "Procedure", "MedicationRequest")

_CODING = "array<struct<system:string,code:string,display:string>>"
_CONCEPT = f"struct<coding:{_CODING},text:string>"
_REF = "struct<reference:string>"
_IDENTIFIER = "array<struct<system:string,value:string>>"
_ADDRESS = "array<struct<line:array<string>,city:string,state:string,postalCode:string,country:string>>"
_PERIOD = "struct<start:string,end:string>"
_NAME = "array<struct<family:string,given:array<string>,prefix:array<string>>>"
_QUANTITY = "struct<value:string,unit:string,code:string>"
_META = "meta struct<versionId:string,lastUpdated:string>"

SCHEMAS = {
    "Patient": f"id string, {_META}, name {_NAME}, birthDate string, gender string, maritalStatus {_CONCEPT}, address {_ADDRESS}, deceasedDateTime string",
    "Practitioner": f"id string, {_META}, name {_NAME}, gender string, active boolean, identifier {_IDENTIFIER}",
    "Organization": f"id string, {_META}, name string, active boolean, type array<{_CONCEPT}>, address {_ADDRESS}, identifier {_IDENTIFIER}",
    "Encounter": f"id string, {_META}, status string, class struct<system:string,code:string,display:string>, type array<{_CONCEPT}>, subject {_REF}, participant array<struct<individual:{_REF},type:array<{_CONCEPT}>>>, period {_PERIOD}, serviceProvider {_REF}",
    "Condition": f"id string, {_META}, subject {_REF}, encounter {_REF}, code {_CONCEPT}, clinicalStatus {_CONCEPT}, verificationStatus {_CONCEPT}, onsetDateTime string, abatementDateTime string, recordedDate string",
    "Observation": f"id string, {_META}, status string, code {_CONCEPT}, category array<{_CONCEPT}>, subject {_REF}, encounter {_REF}, effectiveDateTime string, issued string, valueQuantity {_QUANTITY}, valueCodeableConcept {_CONCEPT}, valueString string, component array<struct<code:{_CONCEPT},valueQuantity:{_QUANTITY},valueCodeableConcept:{_CONCEPT},valueString:string>>",
    "Procedure": f"id string, {_META}, status string, code {_CONCEPT}, subject {_REF}, encounter {_REF}, performedDateTime string, performedPeriod {_PERIOD}",
    "MedicationRequest": f"id string, {_META}, status string, intent string, subject {_REF}, encounter {_REF}, authoredOn string, requester {_REF}, medicationCodeableConcept {_CONCEPT}, medicationReference {_REF}",
}

#: What the gate looks at, for every type at once: nested parts as text, to tell absent from present.
GATE = f"resourceType string, id string, {_META}, status string, intent string, gender string, name string, class string, subject string, code {_CONCEPT}, valueQuantity {_QUANTITY}, component array<struct<valueQuantity:{_QUANTITY}>>, medicationCodeableConcept string, medicationReference string"

EDC_ITEMS = "study_id string, site_id string, subject_id string, visit_id string, form_id string, record_num string, item_oid string, value string"
SUBJECTS = "subject_id string, site_id string, consent_date string, arm string, baseline_date string, completed string"
