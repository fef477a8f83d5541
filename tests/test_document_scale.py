"""What the documents' way to the star does once and on demand: parsing, writing, numbering of lines."""

import json

import pytest
from pyspark.sql import functions as F

from medlattice.operators import gate
from medlattice.plans import warehouse
from medlattice.sources import documents, fixtures


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_parses_a_document_once(spark, tmp_path):
    lines, _ = fixtures.with_defects(fixtures.extract(2))
    fixtures.write_lines(lines, f"{tmp_path}/in")
    for side in gate.validate(documents.read_directory(spark, f"{tmp_path}/in")):
        assert plan(side).count("from_json(") == 1


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("scale")
    fixtures.write_lines({k: [json.dumps(d) for d in v] for k, v in fixtures.extract(6).items()}, f"{root}/in")
    w = warehouse.Warehouse(spark, f"{root}/wh")
    return w, warehouse.ingest(w, documents.read_directory(spark, f"{root}/in"))


def test_tables_are_made_on_demand_and_are_the_same(spark, landed):
    w, got = landed
    t = warehouse.begun(w, {}, "2026-08-01", got["batch_id"])
    assert t["patient"].count() == 6 and t["meta.load_batch"].count() == 1
    assert set(t.made) == {"raw.document", "current", "patient", "meta.load_batch"}
    assert t["fact.encounter_diagnosis"].count() > 0
    assert not {"observation", "fact.observation", "dim.medication"} & set(t.made) and {"fact.encounter", "dim.patient", "dim.diagnosis"} <= set(t.made)
    whole = warehouse.load(w, "2026-08-01", got["batch_id"])
    for name in sorted(set(whole) - {"meta.load_batch"}):
        a, b = t[name].select(*whole[name].columns), whole[name]
        assert a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_child_tables_read_written_parents(spark, landed):
    w, got = landed
    t = warehouse.begun(w, {}, "2026-08-01", got["batch_id"])
    for name, make in t.makers.items():
        if name.endswith("_found") or name in ("unresolved", "resource_coding") or name.startswith("fact."):
            assert plan(make(t)).count("from_json(") <= 1, name  # its own documents; parents' are parsed where they are written


def test_lines_of_a_file_in_many_blocks_are_numbered_without_a_shuffle_of_text(spark, tmp_path):
    lines = [json.dumps({"resourceType": "Patient", "id": str(i), "text": "x" * (i % 50)}) if i % 10 else "" for i in range(1, 3001)]
    for name in ("Patient.a.ndjson", "Patient.b.ndjson"):
        (tmp_path / name).write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = documents.read_directory(spark, str(tmp_path))
        got = rows.select("source_ref", "line_number", F.get_json_object("payload", "$.id").cast("long").alias("id"), "parse_error").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2 * 2700 and all(r.line_number == r.id and r.parse_error is None for r in got)
    assert "row_number" not in plan(rows)  # no window over the lines themselves
