"""Column rules, table operators, readers, the warehouse, the trial pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from medlattice.functions import columns as C
from medlattice.operators import cohorts, edc, history, measures, release, sdtm, shred, tables, views
from medlattice.operators.quality import passed
from medlattice.plans import trial, warehouse
from medlattice.sources import documents, files, fixtures, rest


def one(spark, expr, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("ref", "kind", "target"),
    [("Patient/1", "literal", "1"), ("https://h/x/Patient/a-1", "absolute", "a-1"), ("Practitioner?identifier=s|v", "conditional", None), ("urn:uuid:ab-1", "urn", "ab-1"), ("nonsense", "unparseable", None), (None, "unparseable", None)],
)
def test_references(spark, ref, kind, target):
    assert one(spark, C.reference_kind, ref) == kind
    assert one(spark, C.literal_reference, ref) == target


def test_dates_and_numbers(spark):
    assert one(spark, lambda a, b: C.minutes_by_boundary(a.cast("timestamp"), b.cast("timestamp")), "2020-01-01 00:00:59", "2020-01-01 00:01:01") == 1
    assert one(spark, lambda a, b: C.completed_years(a.cast("date"), b.cast("date")), "2000-12-31", "2018-01-01") == 17
    assert one(spark, lambda a, b: C.years_by_boundary(a.cast("date"), b.cast("date")), "2000-12-31", "2018-01-01") == 18
    assert str(one(spark, C.exact_decimal, "1.2607e-06")) == "0.000001"
    assert one(spark, C.exact_decimal, "x") is None
    assert one(spark, C.term, " Head-Ache  (bad)") == "headache  bad"
    assert one(spark, C.care_setting, "OBSENC") == "Ambulatory" and one(spark, C.care_setting, None) == "Unknown"


def test_upsert_keeps_keys_and_never_deletes(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k long, code string, display string")
    s = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "code string, display string")
    rows = lambda df: sorted((r.k or 0, r.code, r.display) for r in df.collect())
    assert rows(tables.upsert(t, s, ["code"])) == [(0, "c", "C"), (1, "a", "A"), (2, "b", "B")]
    assert rows(tables.upsert(t, s, ["code"], None)) == [(0, "c", "C"), (1, "a", None), (2, "b", "x")]
    assert rows(tables.upsert(t, s, ["code"], "t.display is null and s.display is not null")) == [(0, "c", "C"), (1, "a", "A"), (2, "b", "x")]
    assert rows(tables.with_keys(tables.upsert(t, s, ["code"]), "k", ["code"])) == [(1, "a", "A"), (2, "b", "B"), (3, "c", "C")]


def test_keys_are_dense_over_many_partitions(spark):
    df = spark.range(1000).select(F.lit(None).cast("long").alias("k"), F.format_string("m%04d", "id").alias("m"))
    got = tables.with_keys(df, "k", ["m"]).orderBy("m").collect()
    assert [r.k for r in got] == list(range(1, 1001))


def test_landing_twice_adds_nothing(spark):
    b = spark.createDataFrame([("P", "1", "1", "f", 1), ("P", "1", "1", "f", 2), ("P", "2", "1", "f", 3)], "t string, i string, v string, f string, n int")
    fresh, twice = tables.land(b.where("1 = 0"), b, ["t", "i", "v"], [F.col("n")])
    assert (fresh.count(), twice.count()) == (2, 1)
    fresh, twice = tables.land(fresh, b, ["t", "i", "v"], [F.col("n")])
    assert (fresh.count(), twice.count()) == (0, 3)


def history_rows(df):
    return sorted((r.k, r.city, str(r.effective_from), str(r.effective_to), r.is_current, r.version_number) for r in df.collect())


def test_history_branches(spark):
    src = lambda rows: spark.createDataFrame(rows, "k string, city string, name string")
    first = src([("a", "X", "n"), ("b", "Y", "n"), ("c", None, "n")])
    dim = history.apply_scd2(history.empty_history(first, "k", ["city"], ["name"]), first, "k", ["city"], "2026-08-01", ["name"])
    again = history.apply_scd2(dim, first, "k", ["city"], "2026-08-01", ["name"])
    assert history_rows(again) == history_rows(dim)
    moved = src([("a", "Z", "n"), ("b", "Y", "new"), ("d", "W", "n")])
    two = history.apply_scd2(dim, moved, "k", ["city"], "2026-08-03", ["name"])
    assert history_rows(two) == [
        ("a", "X", "1900-01-01", "2026-08-02", False, 1), ("a", "Z", "2026-08-03", "9999-12-31", True, 2), ("b", "Y", "1900-01-01", "9999-12-31", True, 1),
        ("c", None, "1900-01-01", "9999-12-31", True, 1), ("d", "W", "1900-01-01", "9999-12-31", True, 1),
    ]
    assert {r.k: r.name for r in two.where("is_current").collect()}["b"] == "new"
    fixed = history.apply_scd2(two, src([("a", "Q", "n")]), "k", ["city"], "2026-08-03", ["name"])
    assert [r for r in history_rows(fixed) if r[0] == "a"] == [("a", "Q", "2026-08-03", "9999-12-31", True, 2), ("a", "X", "1900-01-01", "2026-08-02", False, 1)]
    assert history.integrity(fixed, "k").count() == 0
    facts = spark.createDataFrame([("a", "2026-08-02"), ("a", "2026-08-03"), ("a", None), ("zz", "2026-01-01")], "k string, d string")
    got = history.as_of_join(facts, fixed, "k", F.col("d").cast("date"), ["city"])
    assert sorted((r.k, str(r.d), r.city) for r in got.collect()) == [("a", "2026-08-02", "X"), ("a", "2026-08-03", "Q"), ("a", "None", "X"), ("zz", "2026-01-01", None)]


def test_stub_is_filled_in_place(spark):
    src = spark.createDataFrame([("a", "X")], "k string, city string")
    stub = tables.inferred(history.empty_history(src, "k", ["city"]), src, "k", effective_from=C.FIRST_DAY, effective_to=C.OPEN_END, is_current=True, version_number=1, row_hash="")
    got = history.apply_scd2(stub, src, "k", ["city"], "2026-08-03").collect()
    assert [(r.city, r.is_inferred, r.version_number, str(r.effective_from)) for r in got] == [("X", False, 1, "1900-01-01")]


def test_returns_at_the_edges(spark):
    v = spark.createDataFrame([("p", "1", "2020-01-01", "2020-01-05"), ("p", "2", "2020-01-05", "2020-01-06"), ("p", "3", "2020-02-05", "2020-02-06"), ("p", "4", "2020-03-08", None), ("p", "5", "2020-03-09", None)], "who string, id string, s string, e string")
    got = measures.returns(v, "who", F.col("s").cast("date"), F.col("e").cast("date"), "id").orderBy("id").collect()
    assert [r.is_return for r in got] == [0, 1, 1, 0, 0]  # first, day 0, day 30, day 31, open stay before


def test_calendar_size(spark):
    c = measures.calendar(spark)
    assert c.count() == 49_674 and c.where("date_key = 20260331").first().fiscal_year == 2025


def test_line_reader_recovers(spark, tmp_path):
    deep = "[" * 2000 + "]" * 2000
    lines = [b'{"resourceType":"Patient","id":"1"}', b"", b"not json", b"[1]", b'{"resourceType":"Patient","id":"\xff"}', b'{"resourceType":"Patient","id":"2","n":' + b"9" * 5000 + b"}", deep.encode(), b'{"id":"3"}']
    (tmp_path / "Patient.ndjson").write_bytes(b"\n".join(lines))
    rows = {r.line_number: r for r in documents.read_directory(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 3, 4, 5, 6, 7, 8]
    assert rows[1].parse_error is None and rows[8].parse_error is None and "JSON" in rows[3].parse_error and "object" in rows[4].parse_error and "UTF-8" in rows[5].parse_error
    assert rows[7].parse_error is not None
    counts = {r.resource_type: r.n for r in documents.count_by_type(documents.read_directory(spark, str(tmp_path))).collect()}
    assert counts["(untyped)"] == 1 and counts["(unparsed)"] >= 4


def test_bundle_reader(spark, tmp_path):
    p = {"resourceType": "Patient", "id": "1"}
    (tmp_path / "Patient.a.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": p}, {}, {"resource": dict(p, id="2")}]}))
    (tmp_path / "Patient.b.json").write_text(json.dumps({"resourceType": "Bundle", "entry": {"a": 1}}))
    (tmp_path / "Patient.c.json").write_text(json.dumps(p))
    (tmp_path / "Device.json").write_text("{}")
    got = documents.read_directory(spark, str(tmp_path)).collect()
    assert sorted((r.source_ref[-9:-5][-1], r.line_number, r.parse_error) for r in got if r.parse_error) == [("a", 2, "bundle entry has no resource"), ("b", 1, "bundle entry is not an array")]
    assert sorted((r.source_ref[-6], r.line_number) for r in got if not r.parse_error) == [("a", 1), ("a", 3), ("c", 1)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("wh")
    docs = fixtures.extract(10)
    fixtures.write_lines({k: [json.dumps(d) for d in v] for k, v in docs.items()}, f"{root}/in")
    feed, manifest = fixtures.change_feed(docs, every=4)
    fixtures.write_lines({"Patient": [json.dumps(d) for d in feed]}, f"{root}/feed")
    w, t = warehouse.build(spark, f"{root}/wh", f"{root}/in", feed=f"{root}/feed")
    return w, t, manifest


def test_warehouse_is_sound(built):
    _, t, _ = built
    outcomes = warehouse.check(t)
    assert passed(outcomes), [o for o in outcomes if o.n_failures]
    assert len(outcomes) == 11


def test_metrics_of_a_build(built):
    w, t, manifest = built
    said = warehouse.write_metrics(w, t)
    assert json.loads(w.files.text(f"{w.root}/_metrics/metrics.json")) == json.loads(json.dumps(said))
    assert [x["kind"] for x in said["loads"]] == ["bulk", "star", "changefeed", "star"] and all(x["state"] == "succeeded" and x["seconds"] > 0 for x in said["loads"])
    assert said["loads"][2]["counts"]["n_read"] == len(manifest) and said["quality"]["patients with two versions"] == len(manifest)
    assert said["rows"]["patient"] == 10 and said["rows"]["fact.encounter"] == 40
    warehouse.write_metrics(w, t)


def test_gate_closes(built):
    _, t, _ = built
    bad = dict(t, encounter=t["encounter"].unionByName(t["encounter"].limit(1)))
    assert not passed(warehouse.check({k: bad[k] for k in bad}))


def test_history_matches_the_manifest(built):
    _, t, manifest = built
    two = {r.patient_id for r in t["dw.patient"].groupBy("patient_id").count().where("count = 2").collect()}
    assert two == {m["patient_id"] for m in manifest}


def test_star_details(built):
    _, t, _ = built
    f, d = warehouse.parts(t)
    e = {r.encounter_id: r for r in f["encounter"].collect()}
    assert e["p1-e1"].is_readmission == 1 and e["p1-e0"].is_readmission == 0 and e["p1-e2"].is_inpatient == 0
    assert e["p0-e3"].end_date_key == -1 and e["p0-e3"].length_of_stay_days is None
    assert all(r.patient_key != -1 and r.provider_key != -1 and r.organization_key != -1 for r in e.values())
    o = f["observation"].where("observation_id = 'p1-o0b'").orderBy("component_seq").collect()
    assert [r.component_seq for r in o] == [1, 2] and str(o[1].value_quantity) == "0.000001"
    codes = {r.code for r in d["observation_code"].collect()}
    assert "2339-0" in codes and "33747003" not in codes  # LOINC before SNOMED
    panel = {r.patient_id: r.n_visits for r in views.patient_panel(f, d).collect()}
    assert panel["p0"] == 4  # visits of both versions
    m = {r.measure: r.value for r in views.bi_measures(f, d).collect()}
    assert m["encounters"] == 40 and m["inpatient discharges"] == 20 and m["readmissions"] == 10
    steps = [r.n for r in views.feasibility(f, d).orderBy("step").collect()]
    assert steps[-1] <= min(steps[:-1])
    for name in ("volume_monthly", "observation_band", "observation_outlier", "medication_order", "diagnosis", "readmission_rate", "organization_scorecard", "benchmark_trend", "benchmark_quarters", "quality_measures"):
        assert getattr(views, name)(f, d).count() > 0, name


def test_defects_are_quarantined(spark, tmp_path):
    lines, manifest = fixtures.with_defects(fixtures.extract(8))
    fixtures.write_lines(lines, f"{tmp_path}/in")
    w = warehouse.Warehouse(spark, f"{tmp_path}/wh")
    got = warehouse.ingest(w, documents.read_directory(spark, f"{tmp_path}/in"))
    assert got["n_read"] == got["n_accepted"] + got["n_duplicate"] + got["n_rejected"]
    seen = {(r.source_ref.split("/")[-1].split(".")[0], r.line_number): r.reason for r in w.read("stg.rejects").collect()}
    assert len(seen) == len(manifest) == got["n_rejected"] and len({m["defect_class"] for m in manifest}) == 8
    for m in manifest:
        assert m["expected_reason_fragment"] in seen[(m["resource_type"], m["line_number"])], m


class Pages:
    """Two pages of patients, then a page that fails twice."""

    failures = 0

    def get(self, url):
        if "page=2" in url:
            return rest.Reply(200, json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "c"}}]}))
        return rest.Reply(200, json.dumps({"resourceType": "Bundle", "link": [{"relation": "next", "url": "http://x/Patient?page=2"}], "entry": [{"resource": {"resourceType": "Patient", "id": i}, "search": {"mode": "match"}} for i in "ab"]}))


def test_rest_pages_and_retries(spark):
    assert [r["id"] for r, _, _ in rest.search(Pages(), "http://x", "Patient", {"_count": "2"})] == ["a", "b", "c"]
    assert [r["id"] for r, _, _ in rest.search(Pages(), "http://x", "Patient", {}, max_resources=1)] == ["a"]
    assert not list(rest.search(Pages(), "http://x", "Patient", {}, max_pages=0))
    replies = [rest.Reply(503, ""), rest.Reply(429, "", "7"), rest.Reply(200, "{}")]
    waits = []
    assert rest.fetch(type("T", (), {"get": lambda self, url: replies.pop(0)})(), "u", waits.append) == {}
    assert waits[1] == 7.0 and waits[0] <= 0.5
    with pytest.raises(rest.RestError):
        rest.fetch(type("T", (), {"get": lambda self, url: rest.Reply(404, "")})(), "u")
    with pytest.raises(rest.RestError):
        rest.entries({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "OperationOutcome", "issue": [{"severity": "fatal"}]}}]})


ITEMS = {
    ("S1", "SCR", "DM", "1"): {"BRTHDAT": "1980-05-01", "SEX": "F", "RFICDAT": "2026-01-01", "ARM": "A"},
    ("S1", "BASE", "VS", "1"): {"VSDAT": "2026-01-20", "SYSBP": "80", "DIABP": "90", "PULSE": "abc", "TEMP": "", "WEIGHT": "300"},
    ("S1", "WK4", "AE", "1"): {"AETERM": "Head-ache", "AESTDAT": "2025-12-01", "AEENDAT": "2025-11-01", "AESEV": "BAD", "AESER": "Y", "AEREL": "RELATED", "AEOUT": "RECOVERED", "AEACN": ""},
    ("S1", "WK4", "AE", "2"): {"AETERM": "bp high", "AESTDAT": "2026-02-01", "AEENDAT": "", "AESEV": "MILD", "AESER": "N", "AEREL": "RELATED", "AEOUT": "RECOVERED", "AEACN": ""},
    ("S2", "EOS", "DS", "1"): {"DSCOMP": "N", "DSTERM": "", "DSSTDAT": "2026-06-20"},
}


@pytest.fixture(scope="module")
def study(spark):
    rows = [("ST", "site1", s, v, f, n, oid, value, i) for i, ((s, v, f, n), items) in enumerate(ITEMS.items()) for oid, value in items.items()]
    items = spark.createDataFrame(rows, "study_id string, site_id string, subject_id string, visit_id string, form_id string, record_num string, item_oid string, value string, ord long")
    subjects = spark.createDataFrame([("S1", "site1", "2026-01-01", "A", "2026-01-15", "1"), ("S2", "site1", "2026-01-02", "B", "2026-01-10", "0")], "subject_id string, site_id string, consent_date string, arm string, baseline_date string, completed string")
    return trial.run(items, subjects), subjects


def test_edit_checks(study):
    t, _ = study
    q = t["queries"].orderBy("query_id").collect()
    assert {(r.subject_id, r.form_id, r.record_num, r.item_oid, r.check_id) for r in q} == {
        ("S1", "", "", "", "EC-VISIT-01"), ("S1", "VS", "1", "PULSE", "EC-CODE"), ("S1", "VS", "1", "WEIGHT", "EC-RANGE"), ("S1", "VS", "1", "SYSBP", "EC-VS-03"),
        ("S1", "AE", "1", "AESEV", "EC-CODE"), ("S1", "AE", "1", "AEENDAT", "EC-AE-01"), ("S1", "AE", "1", "AESTDAT", "EC-AE-04"), ("S1", "AE", "1", "AEACN", "EC-AE-05"), ("S1", "AE", "2", "AEENDAT", "EC-AE-06"), ("S2", "DS", "1", "DSTERM", "EC-DS-01"),
    }
    assert [r.query_id for r in q] == [f"Q{i:05d}" for i in range(1, len(q) + 1)] and q[0].check_id == "EC-VISIT-01"
    assert "5 day(s) outside" in q[0].query_text and "30 to 250 kg" in next(r.query_text for r in q if r.check_id == "EC-RANGE")


def test_domains_and_coding(study, spark):
    t, subjects = study
    dm = {r.SUBJID: r for r in t["dm"].collect()}
    assert dm["S1"].AGE == 45 and dm["S1"].SEX == "F" and dm["S2"].ARMCD == "B" and dm["S2"].AGE is None
    assert [(r.AESEQ, r.AEDECOD) for r in t["ae"].orderBy("AESEQ").collect()] == [(1, "Headache"), (2, "Hypertension | Blood pressure increased")]
    assert [(r.VSSEQ, r.VSTESTCD) for r in t["vs"].orderBy("VSSEQ").collect()] == [(1, "SYSBP"), (2, "DIABP"), (3, "PULSE"), (4, "WEIGHT")]
    assert {r.rule for r in t["sdtm_conformance"].collect()} == {"SEX is required"}
    assert sdtm.conformance("AE", t["ae"].where("1 = 0")).count() == 0
    assert [(r.verbatim, r.status) for r in t["worklist"].collect()] == [("bp high", "ambiguous")]
    assert cohorts.site_table(subjects).first().arm_a == 1
    kept = cohorts.filter_cohort({"subjects": subjects, "records": t["records"]}, ["site1"], ["A"], "2026-01-01", "2026-01-01")
    assert kept["subjects"].count() == 1 and kept["records"].count() == 4


def test_release_decision(study, spark):
    t, subjects = study
    q = t["queries"]
    keys = ["subject_id", "visit_id", "form_id", "record_num", "item_oid"]
    planted = spark.createDataFrame([("f", 1, "c", "status")], "source_ref string, line_number long, defect_class string, expected_reason_fragment string")
    evidence = {"subjects": subjects, "trial_defects": q.select(*keys, F.col("check_id").alias("expected_check")), "sdtm_conformance": t["sdtm_conformance"].where("1 = 0"), "fhir_defects": planted, "fhir_rejects": spark.createDataFrame([("f", 1, "status: required")], "source_ref string, line_number long, reason string")}
    metrics = {"source": {"jar_sha256": "a" * 64, "seed": 1}, "row_ledger": True}
    said = {r.gate_id: r.status for r in trial.decide(t, evidence, metrics).collect()}
    assert said["DECISION"] == "REVIEW REQUIRED" and said["UAT-01"] == "REVIEW" and said["COHORT-01"] == "PASS" and said["FHIR-01"] == "PASS"
    fewer = dict(t, dm=t["dm"].where("SUBJID != 'S1'"))
    assert {r.gate_id: r.status for r in trial.decide(fewer, evidence, metrics).collect()}["DECISION"] == "BLOCKED"
    with pytest.raises(ValueError):
        release.load_policy('{"schema_version": "9"}')
    a = release.register_fingerprint(cohorts.register({"all": ("all", subjects)}), release.decision(spark.createDataFrame([("x", "PASS")], "gate_id string, status string")))
    assert len(a) == 64


def test_ageing(spark):
    q = spark.createDataFrame([("Q1", "s"), ("Q2", "s"), ("Q3", "s")], "query_id string, site_id string")
    d = spark.createDataFrame([("Q1", "2026-07-01", "2026-07-04"), ("Q2", "2026-07-01", "2026-07-11"), ("Q3", "2026-06-20", None)], "query_id string, issued_date string, closed_date string").select("query_id", F.col("issued_date").cast("date").alias("issued_date"), F.col("closed_date").cast("date").alias("closed_date"))
    log = edc.query_log(q, d)
    assert log.where("query_id = 'Q3'").first().age_band == "31-60 days"
    s = edc.site_performance(log).first()
    assert (s.queries_raised, s.queries_open, s.median_days_to_close, s.close_rate) == (3, 1, 10, 0.6667)


def test_csv_blanks_stay_empty(spark, tmp_path):
    (tmp_path / "s.csv").write_text("subject_id,site_id,consent_date,arm,baseline_date,completed\nS1,,2026-01-01,A,\"\",1\n")
    r = files.read_subjects(spark, str(tmp_path / "s.csv")).first()
    assert r.site_id == "" and r.baseline_date == ""


def test_codings_are_numbered(spark):
    docs = [(k, d["id"], json.dumps(d)) for k, v in fixtures.extract(1).items() for d in v]
    c = shred.codings(spark.createDataFrame(docs, "resource_type string, resource_id string, payload string"))
    own = c.where("resource_id = 'p0-o0a'").orderBy("coding_seq").collect()
    assert [(r.coding_seq, r.code) for r in own] == [(1, "33747003"), (2, "2339-0")]


def test_lineage_names_real_columns(built):
    from medlattice.operators import constraints, lineage

    _, t, _ = built
    assert lineage.broken(t) == []
    assert ("encounter", "patient_id", "string", "references patient.patient_id") in constraints.catalog(t)


def test_lineage_of_star_columns_in_plans(built):
    from medlattice.operators import lineage, shred, star

    w, _, _ = built
    now = w.snapshot()
    norm = {k: now.read(k) for k in now.tables if "." not in k}
    norm["code"] = shred.code_view(norm["code_system"], norm["code_concept"])
    dims = star.dimensions(norm, {}, "2026-08-01")
    facts = star.facts(norm, {n: now.read(f"dim.{n}") if f"dim.{n}" in now else df for n, df in dims.items()}, "b")
    made = {f"dw.{k}": v for k, v in dims.items()} | {f"fact.{k}": v for k, v in facts.items()}
    assert lineage.unmapped(made) == [] and lineage.wrong(made) == []
    p = lineage.provenance(dims["patient"])
    assert p["age_band"] == {("patient", "birth_date")} and ("patient", "given_name") in p["full_name"]
    assert lineage.provenance(facts["encounter"])["start_date_key"] == {("encounter", "period_start")}
    assert lineage.wrong(made, [("x", "patient.gender", "dw.patient.birth_date"), ("y", "encounter.period_end", "fact.encounter.start_date_key"), ("z", "encounter.status", "fact.encounter.status")]) == ["x: patient.gender -> dw.patient.birth_date", "y: encounter.period_end -> fact.encounter.start_date_key"]


def test_reverification_closes_the_release(study, spark):
    t, subjects = study
    keys = ["subject_id", "visit_id", "form_id", "record_num", "item_oid"]
    planted = spark.createDataFrame([("f", 1, "c", "status")], "source_ref string, line_number long, defect_class string, expected_reason_fragment string")
    done = edc.test_cases(spark).withColumn("pass_fail", F.lit("pass"))
    evidence = {**t, "uat": done, "subjects": subjects, "trial_defects": t["queries"].select(*keys, F.col("check_id").alias("expected_check")), "sdtm_conformance": t["sdtm_conformance"].where("1 = 0"), "fhir_defects": planted, "fhir_rejects": spark.createDataFrame([("f", 1, "status: required")], "source_ref string, line_number long, reason string")}
    said = release.reverification_probe(evidence, {"source": {"jar_sha256": "a" * 64, "seed": 1}, "row_ledger": True})
    assert said == {"decision_before": "READY", "decision_after": "BLOCKED", "changed_gates": ["COHORT-01"], "cohort_gate_before": "PASS", "cohort_gate_after": "BLOCK"}
    policy = dict.fromkeys(release.POLICY_KEYS, "x") | {"schema_version": 1}
    assert release.load_policy(json.dumps(policy)) == policy
    with pytest.raises(ValueError, match="cohorts, control_id"):
        release.load_policy(json.dumps({k: v for k, v in policy.items() if k not in ("cohorts", "control_id")}))


def test_sql_functions_are_inlined(spark):
    from medlattice.functions import sql

    sql.register(spark)
    df = spark.sql("select reference_id(concat('Patient/', t.id)) as a, coded_term(' Ab-c! ') as t, r.id as b from range(3) t, lateral reference_ids(concat('X/', t.id)) r")
    assert sorted(map(tuple, df.collect())) == [("0", "abc", "0"), ("1", "abc", "1"), ("2", "abc", "2")]
    assert "PythonUDF" not in df._jdf.queryExecution().toString()


def test_rest_data_source(spark, tmp_path):
    bundle = lambda ids, nxt: json.dumps({"resourceType": "Bundle", "link": [{"relation": "next", "url": nxt}] if nxt else [], "entry": [{"resource": {"resourceType": "Patient", "id": i}} for i in ids]})
    (tmp_path / "Patient.json").write_text(bundle(["a", "b"], f"file://{tmp_path}/Patient-2.json"))
    (tmp_path / "Patient-2.json").write_text(bundle(["c"], None))
    spark.dataSource.register(rest.RestSearch)
    rows = spark.read.format("rest_search").option("base_url", f"file://{tmp_path}").option("types", "Patient").option("transport", "medlattice.sources.rest.FileTransport").load()
    assert sorted(json.loads(r.payload)["id"] for r in rows.collect()) == ["a", "b", "c"]
    assert rows.where("mode = 'match'").count() == 3
