"""Snapshot loads, the warehouse on top of them, streams that land and keep history exactly once, the incremental pull."""

import json
import os
import shutil
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from medlattice.operators import history, tables
from medlattice.plans import warehouse
from medlattice.sources import documents, fixtures, rest
from medlattice.sources.snapshots import Conflict, Store
from medlattice.streaming.history import apply_changes, type2_stream
from medlattice.streaming.landing import land_stream, without_repeats


def test_loads_are_seen_whole_or_not(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    assert s.snapshot().version == 0 and s.read("a", "n long").count() == 0
    with s.begin("one") as load:
        load.write("a", spark.range(3))
        load.append("b", spark.range(2).select("id", F.lit("x").alias("kind")), "kind")
        assert load.read("a").count() == 3 and "a" not in s.snapshot()
        load.counts = {"n": 5}
    with s.begin("two") as load:
        load.append("b", spark.range(4).select("id", F.lit("y").alias("kind")), "kind")
        assert load.read("b").count() == 6
    assert sorted(map(tuple, s.read("b").groupBy("kind").count().collect())) == [("x", 2), ("y", 4)]
    assert s.snapshot(1).read("b").count() == 2  # versions stay
    with pytest.raises(ZeroDivisionError), s.begin("bad") as load:
        load.write("a", spark.range(99))
        raise ZeroDivisionError("half way")
    with pytest.raises(KeyError):
        s.read("none")
    assert s.read("a").count() == 3 and s.snapshot().version == 2
    said = {r.kind: (r.state, r.version, dict(r.counts or {}), r.error) for r in s.loads().collect()}
    assert said["one"] == ("succeeded", 1, {"n": 5}, None) and said["bad"][0] == "failed" and "half way" in said["bad"][3]
    s.compact("b")
    assert s.read("b").count() == 6 and len(s.snapshot().tables["b"].entries) == 1
    assert s.vacuum(keep=1) == 3  # two of b, one of the failed load
    assert s.read("b").count() == 6 and s.read("a").count() == 3


def test_loads_that_meet(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    a, b = s.begin("a"), s.begin("b")
    a.append("t", spark.range(2))
    b.append("t", spark.range(3))
    assert (a.commit(), b.commit()) == (1, 2) and s.read("t").count() == 5  # both appended
    a, b = s.begin("a"), s.begin("b")
    a.write("t", spark.range(1))
    b.append("t", spark.range(1), unique=True)
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert s.read("t").count() == 1


def test_codes_of_writers_at_once_have_one_key_each(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    start = threading.Barrier(2)

    def register(codes):
        def work(load):
            old = load.read("code", "code string, code_id long")
            new = tables.with_keys(tables.upsert(old, spark.createDataFrame([(c,) for c in codes], "code string"), ["code"], None), "code_id", ["code"])
            rows = load.scratch("new", new)
            if load.base.version == 0:
                start.wait(60)  # both have read the empty table
            load.write("code", rows)

        s.transact("codes", work)

    writers = [threading.Thread(target=register, args=(c,)) for c in (["a", "b", "c"], ["b", "c", "d"])]
    [w.start() for w in writers]
    [w.join(120) for w in writers]
    got = s.read("code").collect()
    assert sorted(r.code for r in got) == ["a", "b", "c", "d"] and sorted(r.code_id for r in got) == [1, 2, 3, 4]
    assert sorted(r.state for r in s.loads().collect()) == ["failed", "succeeded", "succeeded"]


DIES = """
import os, sys
from medlattice.session import session
from medlattice.sources.snapshots import Store
spark = session("dies", cores="1", shuffle_partitions=1, driver_memory="1g")
load = Store(spark, sys.argv[1]).begin("bulk")
load.write("a", spark.range(77))
load.append("b", spark.range(77))
os._exit(9)
"""


def test_a_load_that_is_killed_leaves_the_version_before(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.transact("bulk", lambda load: (load.write("a", spark.range(3)), load.append("b", spark.range(2))))
    died = subprocess.run([sys.executable, "-c", DIES, f"{tmp_path}/s"], env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}, capture_output=True, timeout=120)
    assert died.returncode == 9, died.stderr[-500:]
    again = Store(spark, f"{tmp_path}/s")
    assert again.read("a").count() == 3 and again.read("b").count() == 2
    assert sorted(r.state for r in again.loads().collect()) == ["running", "succeeded"]
    assert again.vacuum(keep=1) == 0 and again.vacuum(keep=1, idle_s=0) == 2  # not while it may still be at work
    again.transact("bulk", lambda load: load.append("b", spark.range(1)))
    assert again.read("b").count() == 3


def test_ingest_of_rejects_only_and_of_nothing(spark, tmp_path):
    w = warehouse.Warehouse(spark, f"{tmp_path}/wh")
    fixtures.write_lines({"Patient": ['[1, 2]', "7", '"text"', "null", "{", json.dumps({"resourceType": "Patient", "id": "no no"})]}, f"{tmp_path}/bad")
    got = warehouse.ingest(w, documents.read_directory(spark, f"{tmp_path}/bad"))
    assert (got["n_read"], got["n_accepted"], got["n_rejected"]) == (6, 0, 6)
    assert w.read("raw.document").count() == 0
    got = warehouse.ingest(w, documents.read_directory(spark, f"{tmp_path}/wh"))  # no file of a known type
    assert (got["n_read"], got["n_rejected"]) == (0, 0)
    t = warehouse.load(w, "2026-08-01", "x")
    assert t["patient"].count() == 0 and t["fact.encounter"].count() == 0


def test_ingest_writes_its_own_rows_only(spark, tmp_path):
    docs = fixtures.extract(3)
    lines = [json.dumps(d) for d in docs["Patient"]]
    mixed = [lines[0], "[]", lines[1], "3", "null", lines[2]]  # good ones between what is no object
    fixtures.write_lines({"Patient": mixed}, f"{tmp_path}/in")
    w = warehouse.Warehouse(spark, f"{tmp_path}/wh")
    read = lambda: documents.read_directory(spark, f"{tmp_path}/in")
    first = warehouse.ingest(w, read(), limit=4)
    assert (first["n_read"], first["n_accepted"], first["n_rejected"]) == (4, 2, 2)
    before = w.snapshot().tables["raw.document"].entries
    second = warehouse.ingest(w, read())
    assert (second["n_accepted"], second["n_duplicate"], second["n_rejected"]) == (1, 2, 3)
    after = w.snapshot().tables["raw.document"].entries
    assert after[:1] == before and len(after) == 2 and w.read("raw.document").where(F.col("batch_id") == second["batch_id"]).count() == 1
    faulty = warehouse.ingest(warehouse.Warehouse(spark, f"{tmp_path}/wh2"), documents.read_directory(spark, fixtures.write_lines({k: [json.dumps(d) for d in v] for k, v in docs.items()}, f"{tmp_path}/all")), inject_every=4)
    assert faulty["n_rejected"] > 0 and faulty["n_read"] == faulty["n_accepted"] + faulty["n_rejected"] + faulty["n_duplicate"]
    with pytest.raises(RuntimeError, match="stop"):
        w.transact("bulk", lambda load: (_ for _ in ()).throw(RuntimeError("stop")))
    assert sorted((r.status, r.n_read) for r in warehouse.batches(w).collect()) == [("failed", 0), ("succeeded", 4), ("succeeded", 6)]


def test_stream_lands_once_with_its_rejects(spark, tmp_path):
    docs = [json.dumps(d) for d in fixtures.extract(3)["Patient"]]
    fixtures.write_lines({"Patient": [*docs, docs[0], "oops", "oops"]}, f"{tmp_path}/in")
    s = Store(spark, f"{tmp_path}/wh")
    run = lambda: land_stream(spark, f"{tmp_path}/in", s, f"{tmp_path}/cp", within="1 hour").awaitTermination()
    run()
    assert s.read("raw.document").count() == 3 and s.read("stg.rejects").count() == 1  # repeats, also of rejects, went before
    fixtures.write_lines({"Patient.again": [*docs[:2], "worse"]}, f"{tmp_path}/in")
    run()
    assert s.read("raw.document").count() == 3 and s.read("stg.rejects").count() == 2
    last = max(int(n) for n in os.listdir(f"{tmp_path}/cp/commits") if n.isdigit())
    versions = s.snapshot().version
    os.remove(f"{tmp_path}/cp/commits/{last}")  # as if the query had died after the load and before its own commit
    crc = f"{tmp_path}/cp/commits/.{last}.crc"
    os.path.exists(crc) and os.remove(crc)
    run()
    assert s.read("raw.document").count() == 3 and s.read("stg.rejects").count() == 2 and s.snapshot().version >= versions


def test_repeats_within_and_beyond_the_watermark(spark, tmp_path):
    rows = lambda n, *r: spark.createDataFrame(r, "k string, at string").coalesce(1).write.json(f"{tmp_path}/in/{n}")
    seen = []

    def run():
        lines = spark.readStream.schema("k string, at timestamp").json(f"{tmp_path}/in/*")
        q = without_repeats(lines, ["k"], "at", "1 hour").writeStream.foreachBatch(lambda df, n: seen.extend(r.k for r in df.collect()) or None).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"])

    rows(1, ("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:10:00"), ("b", "2026-01-01 00:20:00"))
    run()
    assert sorted(seen) == ["a", "b"]
    rows(2, ("a", "2026-01-01 00:30:00"), ("c", "2026-01-01 05:00:00"))  # a again within the hour
    run()
    assert sorted(seen) == ["a", "b", "c"]
    rows(3, ("a", "2026-01-01 05:10:00"), ("d", "2026-01-01 09:00:00"))  # its key has expired
    held = run()
    assert sorted(seen) == ["a", "a", "b", "c", "d"] and held <= 2


CHANGES = [("x", 1, "A", 1), ("x", 5, "B", 2), ("x", 3, "A", 3), ("y", 2, "C", 4), ("x", 4, "C", 5), ("y", 2, "D", 6), ("z", 9, "A", 7), ("x", 9, "B", 8)]


def test_type2_stream_in_any_order(spark, tmp_path):
    of = lambda rows: spark.createDataFrame(rows, "k string, day int, v string, n int")
    want = history.versions(of(CHANGES).groupBy("k", "day").agg(F.max_by(F.struct("v"), "n").alias("t")).select("k", "day", "t.*"), "k", "day", ["v"])
    want = sorted(map(tuple, want.select("k", "v", "valid_from", "valid_to", "version_number", "is_current").collect()), key=repr)
    assert len([w for w in want if w[0] == "x"]) == 3 and ("y", "D", 2, None, 1, True) in want
    s = Store(spark, f"{tmp_path}/s")
    got = lambda: sorted(map(tuple, s.read("dim").select("k", "v", "valid_from", "valid_to", "version_number", "is_current").collect()), key=repr)
    for i in range(3):
        of(CHANGES[i::3]).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    lines = spark.readStream.schema("k string, day int, v string, n int").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    run = lambda: type2_stream(s, "dim", lines, "k", "day", ["v"], "n", f"{tmp_path}/cp", parts=4).awaitTermination()
    run()
    assert got() == want and s.snapshot().streams == {f"{tmp_path}/cp": 2}
    shutil.rmtree(f"{tmp_path}/cp/commits")  # all batches come again
    run()
    assert got() == want and s.read("dim.changes").count() == len(CHANGES)
    assert not apply_changes(s, "dim", of([("x", 0, "Z", 0)]), "k", "day", ["v"], "n", f"{tmp_path}/cp", 1, 4)
    assert apply_changes(s, "dim", of([]), "k", "day", ["v"], "n", "other", 0, 4) and got() == want


def page(ids, nxt=None):
    return json.dumps({"resourceType": "Bundle", "link": [{"relation": "next", "url": nxt}] if nxt else [], "entry": [{"resource": {"resourceType": "Patient", "id": i, "meta": {"lastUpdated": at} if at else {}}} for i, at in ids]})


def test_pull_goes_on_where_it_was(spark, tmp_path):
    spark.dataSource.register(rest.RestSearch)
    out = {}

    def run(until, checkpoint="cp", **more):
        batch = []
        rows = spark.readStream.format("rest_search").options(base_url=f"file://{tmp_path}/pages", types="Patient", transport="medlattice.sources.rest.FileTransport", until=until, **more).load()
        rows.writeStream.foreachBatch(lambda df, n: batch.extend(json.loads(r.payload)["id"] for r in df.collect()) or None).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return sorted(batch)

    os.makedirs(f"{tmp_path}/pages")
    first = [("a", "2026-01-01T00:00:00Z"), ("b", "2026-01-02T00:00:00Z"), ("n", None)]
    put = lambda name, text: open(f"{tmp_path}/pages/{name}.json", "w").write(text)
    put("Patient", page(first, f"file://{tmp_path}/pages/Patient-2.json"))
    put("Patient-2", page([("c", "2026-01-03T00:00:00+01:00")]))
    assert run("2026-01-02T00:00:00Z") == ["a", "n"]  # the end is excluded
    put("Patient-2", "no JSON")
    with pytest.raises(Exception, match="not JSON"):
        run("2026-01-05T00:00:00Z")
    put("Patient-2", page([("c", "2026-01-03T00:00:00+01:00"), ("d", "2026-02-01T00:00:00Z")]))
    assert run("2026-01-06T00:00:00Z") == ["b", "c"]  # the batch that failed comes again as it was planned
    assert run("2026-01-06T00:00:00Z") == [] and run("2026-03-01T00:00:00Z") == ["d"]
    assert run("2026-03-01T00:00:00Z", "other", since="2026-01-02T00:00:00Z", splits="7") == ["b", "c", "d"]
    reader = rest.PullReader({"types": "A,B", "base_url": "x", "splits": "3"})
    parts = reader.partitions({"until": "2026-01-01T00:00:00Z"}, {"until": "2026-01-04T00:00:00Z"})
    assert [(p.kind, p.since[:10], p.until[:10]) for p in parts[:3]] == [("A", "2026-01-01", "2026-01-02"), ("A", "2026-01-02", "2026-01-03"), ("A", "2026-01-03", "2026-01-04")] and len(parts) == 6
    assert reader.partitions({"until": "2026-01-04T00:00:00Z"}, {"until": "2026-01-01T00:00:00Z"}) == []


def test_constraints_are_trusted_until_rows_change(spark, tmp_path):
    from medlattice.operators import trust

    docs = fixtures.extract(3)
    fixtures.write_lines({k: [json.dumps(d) for d in v] for k, v in docs.items()}, f"{tmp_path}/in")
    w, t = warehouse.build(spark, f"{tmp_path}/wh", f"{tmp_path}/in")
    some = {k: t[k] for k in ("patient", "patient_address", "encounter", "procedure", "dw.patient", "fact.procedure")}
    states = lambda: {(r.table_name, r.constraint_name): (r.state, r.n_rows) for r in trust.states(w, list(some)).collect()}
    assert {s for s, _ in states().values()} == {"untrusted"}
    trust.validate(w, some)
    now = states()
    assert set(now.values()) == {("trusted", 0)} and ("fact.procedure", "patient_key -> dw.patient") in now and ("dw.patient", "effective") in now
    odd = t["encounter"].limit(1).withColumn("status", F.lit("gone"))
    w.transact("bulk", lambda load: load.append("encounter", odd))
    after = states()
    changed = {k for k, v in after.items() if v[0] == "untrusted"}
    assert changed == {k for k in now if k[0] == "encounter" or k[1].endswith("-> encounter")} and ("encounter", "status") in changed
    trust.validate(w, some | {"encounter": w.read("encounter")})
    last = states()
    assert last[("encounter", "status")] == ("violated", 1) and last[("encounter", "unique (encounter_id)")] == ("violated", 1)
    assert last[("procedure", "encounter_id -> encounter")] == ("trusted", 0)


def test_metrics_of_a_query(spark, tmp_path):
    from medlattice.measure import measured

    spark.range(10_000).selectExpr("id", "id % 7 as k", "uuid() as u").write.parquet(f"{tmp_path}/t")
    got = measured(spark, lambda: spark.read.parquet(f"{tmp_path}/t").groupBy("k").count())
    assert got["rows_read"] == 10_000 and got["bytes_read"] > 0 and got["bytes_shuffled"] > 0 and got["jobs"] == 1 and got["seconds"] > 0
    assert {"Scan", "HashAggregate", "Exchange"} <= set(got["plan"])
