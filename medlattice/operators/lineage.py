"""Where each document element goes: normalized column, star column. Checked against the tables' columns, and against the analysed plans
that make them: provenance() follows every output column back to the columns of the tables that are read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..shared import made_of

#: Fixed values: (element path, normalized table.column, star table.column or none).
MAPPINGS = [
    ("Patient.birthDate", "patient.birth_date", "dw.patient.birth_date"), ("Patient.gender", "patient.gender", "dw.patient.gender"), ("Patient.maritalStatus.coding[0].code", "patient.marital_status", "dw.patient.marital_status"),
    ("Patient.address[].city", "patient_address.city", "dw.patient.city"), ("Patient.address[].state", "patient_address.state", "dw.patient.state"), ("Patient.address[].postalCode", "patient_address.postal_code", "dw.patient.postal_code"),
    ("Practitioner.name[0]", "practitioner.family_name", "dw.provider.full_name"), ("Practitioner.identifier[]", "practitioner_identifier.identifier_value", "dw.provider.npi"), ("Organization.name", "organization.name", "dw.organization.name"),
    ("Encounter.class.code", "encounter.class_code", "dw.encounter_type.class_code"), ("Encounter.period.start", "encounter.period_start", "fact.encounter.start_date_key"), ("Encounter.period.end", "encounter.period_end", "fact.encounter.length_of_stay_days"),
    ("Encounter.participant[]", "encounter.primary_performer_id", "fact.encounter.provider_key"), ("Encounter.serviceProvider", "encounter.service_provider_id", "fact.encounter.organization_key"), ("Condition.code.coding[]", "condition.code_concept_id", "fact.encounter_diagnosis.diagnosis_key"),
    ("Condition.onsetDateTime", "condition.onset_datetime", "fact.encounter_diagnosis.onset_date_key"), ("Observation.code.coding[]", "observation.code_concept_id", "fact.observation.observation_code_key"), ("Observation.valueQuantity.value", "observation.value_quantity", "fact.observation.value_quantity"),
    ("Observation.component[]", "observation_component.component_seq", "fact.observation.component_seq"), ("Procedure.performed[x]", "procedure.performed_start", "fact.procedure.performed_date_key"), ("MedicationRequest.medication[x]", "medication_request.code_concept_id", "fact.medication_order.medication_key"),
    ("MedicationRequest.requester", "medication_request.requester_id", "fact.medication_order.provider_key"),
]


def broken(tables: dict[str, DataFrame]) -> list[str]:
    """Mappings that name a table or column that isn't there."""
    out = []
    for element, *targets in MAPPINGS:
        for target in targets:
            table, _, column = target.rpartition(".")
            if table not in tables or column not in tables[table].columns:
                out.append(f"{element} -> {target}")
    return out


def _seq(jvm_seq) -> list:
    return [jvm_seq.apply(i) for i in range(jvm_seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _structs(expression) -> list[list]:
    """The values of each struct that an expression makes, the outermost only."""
    if _kind(expression) == "CreateNamedStruct":
        return [_seq(expression.valExprs())]
    return [x for c in _seq(expression.children()) for x in _structs(c)]


class _Walk:
    """Sources of attributes by their ids, collected from the leaves of a plan upwards."""

    def __init__(self):
        self.of: dict[int, frozenset] = {}

    def refs(self, expression) -> frozenset:
        out: frozenset = frozenset()
        for a in _seq(expression.references().toSeq()):
            out |= self.of.get(a.exprId().id(), frozenset())
        return out

    def visit(self, plan) -> None:
        children = _seq(plan.children())
        for c in children:
            self.visit(c)
        if not children:
            self._leaf(plan)
        elif _kind(plan) == "Union":
            for i, a in enumerate(_seq(plan.output())):
                self.of[a.exprId().id()] = frozenset().union(*(self.of.get(_seq(c.output())[i].exprId().id(), frozenset()) for c in children))
        else:
            if _kind(plan) == "Generate":
                outputs = _seq(plan.generatorOutput())
                rows = [x for x in _structs(plan.generator()) if len(x) == len(outputs)] if _kind(plan.generator()) == "Inline" else []
                for i, a in enumerate(outputs):  # rows that the plan itself puts together are told apart by column
                    self.of[a.exprId().id()] = frozenset().union(*(self.refs(x[i]) for x in rows)) if rows else self.refs(plan.generator())
            for e in _seq(plan.expressions()):
                if _kind(e) == "Alias":
                    self.of[e.exprId().id()] = self.refs(e.child())

    def _leaf(self, plan) -> None:
        attributes = _seq(plan.output())
        if _kind(plan) != "LogicalRelation":
            self.of |= {a.exprId().id(): frozenset() for a in attributes}
            return
        path = plan.relation().location().rootPaths().apply(0).toString().split("/")
        load = next((i for i, part in enumerate(path) if part.startswith("load=")), None)
        table = path[load - 1] if load is not None else path[-1]
        inner = made_of(table) if load is None else None
        before = provenance(inner) if inner is not None else None
        for a in attributes:
            own = before.get(a.name()) if before is not None else None
            self.of[a.exprId().id()] = own if own is not None else frozenset({(table, a.name())})


def provenance(df: DataFrame) -> dict[str, frozenset]:
    """Column -> (table, column) pairs that its values are computed from, in the plan of df. Tables are those of a snapshot store, by name;
    tables in between that shared.written() made are looked through. Join conditions, filters and groupings are not sources of values."""
    plan = df._jdf.queryExecution().analyzed()
    walk = _Walk()
    walk.visit(plan)
    return {a.name(): walk.of.get(a.exprId().id(), frozenset()) for a in _seq(plan.output())}


#: Star columns that come from no column of a document: keys that are numbered, constants, and what a load itself knows.
OWN = ("load_batch_id", "is_inferred", "version_number", "effective_from", "effective_to", "is_current", "row_hash", "encounter_count", "result_count", "order_count", "diagnosis_count", "procedure_count")

#: Tables that a rule makes, without documents.
GENERATED = ("dw.date",)


def unmapped(made: dict[str, DataFrame]) -> list[str]:
    """Star columns (made: by table name, as they were made, not as read back) without a source that aren't keys or in OWN."""
    out = []
    for table, df in made.items():
        for column, found in provenance(df).items() if table not in GENERATED else ():
            if not found and column not in OWN and not column.endswith("_key"):
                out.append(f"{table}.{column}")
    return out


def wrong(made: dict[str, DataFrame], mappings: list[tuple[str, str, str]] | None = None) -> list[str]:
    """Mappings whose star column is not computed from their normalized column, directly or, for keys, by a look-up in the dimension that
    holds it."""
    known = {t: provenance(df) for t, df in made.items()}
    out = []
    for element, norm, star in MAPPINGS if mappings is None else mappings:
        table, _, column = star.rpartition(".")
        if table not in known:
            continue
        found = known[table].get(column, frozenset())
        source = tuple(norm.rsplit(".", 1))
        via = {t for t, c in found if c == column and t.startswith("dim.")} if column.endswith("_key") else set()
        if source not in found and not via:
            out.append(f"{element}: {norm} -> {star}")
    return out
