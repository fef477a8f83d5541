"""The warehouse build: read, validate, land, shred, load, check. Every step is a load of a snapshot store (sources.snapshots): what it
writes becomes visible at once, when its manifest is in place, and a load that dies leaves the version before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, shred, star, tables, views, warehouse_checks
from ..operators.gate import divided, judged
from ..shared import written
from ..sources.documents import read_directory
from ..sources.fixtures import inject
from ..sources.snapshots import Load, Store

DOCUMENT = "resource_type string, resource_id string, version_id string, last_updated timestamp_ntz, payload string, source_ref string, line_number long, batch_id string"
REJECT = "resource_type string, resource_id string, source_ref string, line_number long, failure_stage string, reason string, detail string, payload string, batch_id string"
LANDED = ["resource_type", "resource_id", "version_id"]
INGESTS = ("bulk", "rest", "changefeed")
Warehouse = Store


def ingest(w: Store, rows: DataFrame, kind: str = "bulk", limit: int | None = None, inject_every: int = 0) -> dict[str, int | str]:
    """Validates read rows and lands what is new; what fails goes to quarantine. Landing the same rows again adds nothing.

    Only the batch's own rows are written, in folders of its own. Two ingests at once are told apart at the commit: the later one starts
    again on top of the other. Read = accepted + duplicate + rejected, as the batch row says. limit: the first rows by file and line only;
    inject_every: every n-th row, by its place, is made faulty before it is validated (a test of the gate).
    """
    if limit is not None:
        rows = rows.orderBy("source_ref", "line_number").limit(limit)
    if inject_every:
        rows = inject(rows, inject_every)

    def work(load: Load) -> dict[str, int | str]:
        got = load.scratch("judged", judged(rows))
        accepted, rejected = divided(got)
        fresh, _ = tables.land(load.read("raw.document", DOCUMENT), accepted, LANDED, [F.col("source_ref"), F.col("line_number")])
        mine = F.lit(load.id).alias("batch_id")
        landed = load.append("raw.document", fresh.select("*", mine), "resource_type", unique=True)
        rejects = load.append("stg.rejects", rejected.select("*", mine))
        n = {"n_read": got.count(), "n_accepted": landed.count(), "n_rejected": rejects.count()}
        n["n_duplicate"] = accepted.count() - n["n_accepted"]
        load.counts = n
        return {"batch_id": load.id, **n}

    return w.transact(kind, work)


def batches(w: Store) -> DataFrame:
    """The ingests so far, running and failed ones too: (batch_id, batch_kind, status, n_read, n_accepted, n_duplicate, n_rejected)."""
    loads = w.loads().where(F.col("kind").isin(*INGESTS))
    counts = [F.coalesce(F.col("counts")[n], F.lit(0)).alias(n) for n in ("n_read", "n_accepted", "n_duplicate", "n_rejected")]
    return loads.select(F.col("load").alias("batch_id"), F.col("kind").alias("batch_kind"), F.col("state").alias("status"), *counts)


def load(w: Store, effective: str, batch_id: str) -> dict[str, DataFrame]:
    """Shreds the current versions and loads the star at the given day, all of it as one load. Returns all tables by name."""
    return w.transact("star", lambda one: _load(one, effective, batch_id)) | {"meta.load_batch": batches(w)}


def _load(w: Load, effective: str, batch_id: str) -> dict[str, DataFrame]:
    t = tables_of(w, {n: w.read(n) for n in KEPT_ON if n in w}, effective, batch_id)
    return {n: t[n] for n in t if not n.startswith(BETWEEN) and not n.endswith("_found")}


#: Tables that the next load goes on from.
KEPT_ON = ("code_system", "code_concept", *(f"dim.{n}" for n in star.dimension_makers({}, "")))
#: Names of tables that only other tables are made of; what of them is used more than once is written in the shared folder.
BETWEEN = ("codings", "codes", "dim.")


def tables_of(w: Load, before: Mapping[str, DataFrame], effective: str, batch_id: str) -> tables.OnDemand:
    """The tables of a load by name, each written when it is first asked for, once, with what it is made of and nothing else. before: the
    tables of KEPT_ON as the load before left them, none at first."""
    spark, base = w.store.spark, w.base
    empty = dict(zip(("code_system", "code_concept"), shred.empty_terminology(spark)))
    earlier = {n.removeprefix("dim."): n for n in before if n.startswith("dim.")}
    dims = star.dimension_makers(Renamed(before, earlier), effective)
    makers = {
        "raw.document": lambda t: base.read("raw.document", DOCUMENT), "stg.rejects": lambda t: base.read("stg.rejects", REJECT),
        "current": lambda t: shred.current_version(t["raw.document"]), "codings": lambda t: shred.codings(t["current"]), "codes": lambda t: shred.distinct_codes(t["codings"]),
        "code_system": lambda t: shred.register_systems(shred.seeded(before.get("code_system", empty["code_system"])), t["codes"]),
        "code_concept": lambda t: shred.register_concepts(before.get("code_concept", empty["code_concept"]), t["code_system"], t["codes"]),
        **shred.NORM, **{f"dim.{n}": make for n, make in dims.items()}, **{f"fact.{n}": make for n, make in star.fact_makers(batch_id).items()},
        **{f"dw.{n}": lambda t, n=n: star.with_unknown_member(n, t[f"dim.{n}"]) for n in dims},
        "reconciliation": _reconciliation, "source_values": _source_values, "source_components": _source_components,
        "as_of": lambda t: spark.createDataFrame([(effective,)], "day string"),
    }
    own = {"current", "code_system", "code_concept", *(n for n in shred.NORM if not n.endswith("_found")), *(n for n in makers if n.startswith(("dim.", "fact.")))}

    def keep(name: str, df: DataFrame) -> DataFrame:
        if name in own:
            return w.write(name, df, "resource_type" if name == "current" else None)
        return written(df, name) if name in ("codings", "codes") or name.endswith("_found") else df

    return tables.OnDemand(makers, keep)


def begun(w: Store, before: Mapping[str, DataFrame], effective: str, batch_id: str) -> tables.OnDemand:
    """tables_of() a load that stays open, for readers of some of its tables: what is asked for is written in the load's own folders and
    seen here only. meta.load_batch is as of now."""
    t, so_far = tables_of(w.begin("star"), before, effective, batch_id), batches(w)
    t.makers["meta.load_batch"] = lambda _: so_far
    return t


class Renamed(Mapping):
    """Tables by other names, read when they are asked for."""

    def __init__(self, of: Mapping[str, DataFrame], names: Mapping[str, str]):
        self.of, self.names = of, names

    def __getitem__(self, name: str) -> DataFrame:
        return self.of[self.names[name]]

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def _reconciliation(t: Mapping[str, DataFrame]) -> DataFrame:
    lost = t["unresolved"].groupBy("resource_type").agg(F.count("*").alias("unresolved_rows"))
    f = Renamed(t, {n[5:]: n for n in t if n.startswith("fact.")})
    return views.reconciliation(t["current"], t, f).join(lost, "resource_type", "left").withColumn("unresolved_rows", F.coalesce("unresolved_rows", F.lit(0)))


def _source_values(t: Mapping[str, DataFrame]) -> DataFrame:
    d = shred.parsed(t["current"], "Observation", "valueQuantity")
    return d.select(F.col("resource_id").alias("observation_id"), F.col("d.valueQuantity.value").alias("source_value")).where("source_value is not null")


def _source_components(t: Mapping[str, DataFrame]) -> DataFrame:
    d = shred.parsed(t["current"], "Observation", "component")
    rows = d.select(F.col("resource_id").alias("observation_id"), F.posexplode("d.component").alias("i", "c")).select("observation_id", (F.col("i") + 1).alias("component_seq"))
    return rows.join(t["observation"].select("observation_id"), "observation_id", "left_semi")


def parts(t: Mapping[str, DataFrame]) -> tuple[Mapping[str, DataFrame], Mapping[str, DataFrame]]:
    """(facts, dimensions) as the views take them; of tables made on demand, those are made that a view asks for."""
    return Renamed(t, {k[5:]: k for k in t if k.startswith("fact.")}), Renamed(t, {k[3:]: k for k in t if k.startswith("dw.")})


def check(t: dict[str, DataFrame]) -> list[quality.Outcome]:
    return quality.run_checks(warehouse_checks.CHECKS, t)


def build(spark: SparkSession, root: str, extract: str, effective: str = "2026-08-01", feed: str | None = None, feed_day: str = "2026-08-03") -> tuple[Store, dict[str, DataFrame]]:
    """The whole build: the extract, then (if given) a change feed that is ingested and loaded as a second day."""
    w = Store(spark, root)
    got = ingest(w, read_directory(spark, extract))
    t = load(w, effective, str(got["batch_id"]))
    if feed:
        got = ingest(w, read_directory(spark, feed), "changefeed")
        t = load(w, feed_day, str(got["batch_id"]))
    return w, t


def row_counts(t: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), for the metrics file."""
    out = None
    for name, df in t.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def metrics(w: Store, t: dict[str, DataFrame]) -> dict:
    """What a build reports: the loads with their states, counts and seconds, rows by table, and measures of quality."""
    loads = [{"kind": r.kind, "state": r.state, "version": r.version, "seconds": round(r.ended - r.began, 2) if r.ended else None, "counts": dict(r.counts or {})} for r in w.loads().orderBy("began").collect()]
    tables_ = {k: v for k, v in t.items() if k not in ("as_of", "reconciliation", "source_values", "source_components")}
    quality_ = {r.measure: r.value for r in views.quality_measures(*parts(t)).collect()}
    return {"loads": loads, "rows": {r.table_name: r.n_rows for r in row_counts(tables_).orderBy("table_name").collect()}, "quality": quality_}


def write_metrics(w: Store, t: dict[str, DataFrame], name: str = "metrics.json") -> dict:
    """metrics() as a JSON file in the store's folder; the file of an earlier build is replaced."""
    found = metrics(w, t)
    w.files.remove(f"{w.root}/_metrics/{name}")
    w.files.put(f"{w.root}/_metrics/{name}", json.dumps(found, indent=1))
    return found
