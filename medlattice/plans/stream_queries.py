"""Queries of incremental loads: pulls, streams and second loads, with SQL for the state they must leave.

Sources of streams are files made of the driver's tables in the shared folder; each stream runs until it has read all there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import fresh_path
from ..sources import rest
from ..sources.snapshots import Store
from ..streaming import history as stream_history
from ..streaming import landing

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Where the pull is stopped and goes on, and what a recorded page holds.
PULLS, PAGE = ("2026-05-01", "2026-05-02", "2027-01-01"), 100


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _record_pages(docs: DataFrame, folder: str) -> None:
    """Search pages as files, linked in order: docs (kind, n from 0, resource) become folder/kind.json, folder/kind-1.json and so on."""
    pages = docs.groupBy("kind", F.floor(F.col("n") / PAGE).cast("int").alias("page")).agg(F.collect_list("resource").alias("found"))  # PAGE at most
    last = docs.groupBy("kind").agg(F.floor(F.max("n") / PAGE).cast("int").alias("last"))
    name = lambda page: F.concat(F.lit(f"{folder}/"), "kind", F.when(page > 0, F.concat(F.lit("-"), page.cast("string"))).otherwise(""))
    entries = F.array_join(F.transform("found", lambda r: F.concat(F.lit('{"search": {"mode": "match"}, "resource": '), r, F.lit("}"))), ", ")
    link = F.when(F.col("page") < F.col("last"), F.concat(F.lit('{"relation": "next", "url": "'), name(F.col("page") + 1), F.lit('"}'))).otherwise("")
    text = F.concat(F.lit('{"resourceType": "Bundle", "link": ['), link, F.lit('], "entry": ['), entries, F.lit("]}"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        for b in batches:
            for at, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(pafs.FileSystem.from_uri(f"{at}.json")[1]) as f:
                    f.write(body.encode())
            yield b.select(["at"])

    pages.join(last, "kind").select(name(F.col("page")).alias("at"), text.alias("body")).mapInArrow(write, "at string").write.format("noop").mode("overwrite").save()


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def doc(df: DataFrame, kind: str, key: str) -> DataFrame:
        day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col(key) * 7919 % 365).cast("int"))
        resource = F.to_json(F.struct(F.lit(kind).alias("resourceType"), F.concat(F.lit(f"{kind.lower()}-"), F.col(key).cast("string")).alias("id"), F.struct(F.concat(day.cast("string"), F.lit("T00:00:00Z")).alias("lastUpdated")).alias("meta")))
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("n"), resource.alias("resource"))

    return doc(t("customer"), "Patient", "c_custkey").unionByName(doc(t("supplier"), "Practitioner", "s_suppkey"))


@query(f"""
with people as (select 'Patient' as resource_type, 'patient-' || c_custkey as resource_id, date '2026-01-01' + (c_custkey * 7919 % 365)::int as day from customer
  union all select 'Practitioner', 'practitioner-' || s_suppkey, date '2026-01-01' + (s_suppkey * 7919 % 365)::int from supplier)
select resource_type, resource_id, '1' as version_id, day::timestamp as last_updated, case {' '.join(f"when day < date '{d}' then {i}" for i, d in enumerate(PULLS, 1))} end as pull from people""")
def incremental_pull(spark, sf_dir):
    """Recorded search pages pulled three times with one checkpoint, each time up to a later day: every document is landed once, by the
    pull in whose days it was last changed."""
    root = fresh_path(spark, "pull")
    _record_pages(_people(spark, sf_dir), f"{root}/pages")
    spark.dataSource.register(rest.RestSearch)
    store = Store(spark, f"{root}/store")
    for until in PULLS:
        options = {"base_url": f"{root}/pages", "types": "Patient,Practitioner", "transport": "medlattice.sources.rest.FileTransport", "until": until}
        landing.pull_stream(spark, options, store, f"{root}/checkpoint").awaitTermination()
    pulls = store.loads().where("state = 'succeeded'").select(F.col("load").alias("batch_id"), F.col("version").cast("int").alias("pull"))
    return store.read("raw.document").join(F.broadcast(pulls), "batch_id").select("resource_type", "resource_id", "version_id", "last_updated", "pull")


def _event_files(spark: SparkSession, sf_dir: str, root: str, parts: int = 3) -> DataFrame:
    """The events as so many folders of files, dealt out by id, so that each holds events of all times; and a stream of them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(parts):
        e.where(F.pmod("event_id", F.lit(parts)) == i).write.parquet(f"{root}/events/{i}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/events/*")


@query("""
with one as (select user_id, ts, max_by(event_type, event_id) as event_type from events group by all),
h as (select *, lag(event_type) over (partition by user_id order by ts) as before from one)
select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts) as valid_to, row_number() over (partition by user_id order by ts) as version_number, lead(ts) over (partition by user_id order by ts) is null as is_current
from h where before is null or before <> event_type""")
def streaming_type2(spark, sf_dir):
    """A Type 2 table of users' states kept by a stream whose batches hold events of all times; a batch is then applied again, in vain."""
    root = fresh_path(spark, "type2")
    changes = _event_files(spark, sf_dir, root)
    store, at = Store(spark, f"{root}/store"), f"{root}/checkpoint"
    stream_history.type2_stream(store, "user_state", changes, "user_id", "ts", ["event_type"], "event_id", at).awaitTermination()
    again = spark.read.schema(changes.schema).parquet(f"{root}/events/1")
    stream_history.apply_changes(store, "user_state", again, "user_id", "ts", ["event_type"], "event_id", at, store.snapshot().streams[at])
    return store.read("user_state").select("user_id", "event_type", "valid_from", "valid_to", "version_number", "is_current")


@query("""
with docs as (select user_id, event_type, min(ts) as first_ts from events group by all)
select 'Patient' as resource_type, 'user-' || user_id as resource_id, event_type as version_id, true as landed, count(*) over (partition by user_id) as versions from docs
union all select null, null, null, false, count(*) from events where value is null or event_id % 50 = 0 group by all having count(*) > 0""")
def stream_landing(spark, sf_dir):
    """Documents from a stream of files, with many repeats: landed once for each key; cut-off ones are rejected, each of them."""
    root = fresh_path(spark, "landing")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    good = F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"), F.struct(F.col("event_type").alias("versionId")).alias("meta")))
    cut = F.concat(F.lit('{"resourceType": "Patient", "id": "'), F.col("event_id").cast("string"))
    e.select(good.alias("value")).unionByName(e.where("value is null or event_id % 50 = 0").select(cut.alias("value"))).write.text(f"{root}/files")
    store = Store(spark, f"{root}/store")
    landing.land_stream(spark, f"{root}/files", store, f"{root}/checkpoint", files_per_batch=3, within="1 day").awaitTermination()
    d = store.read("raw.document")
    kept = d.select("resource_type", "resource_id", "version_id", F.lit(True).alias("landed"), F.count("*").over(Window.partitionBy("resource_id")).alias("versions"))
    lost = store.read("stg.rejects").groupBy("resource_type", "resource_id").agg(F.count("*").alias("versions"))
    return kept.unionByName(lost.select("resource_type", "resource_id", F.lit(None).cast("string").alias("version_id"), F.lit(False).alias("landed"), "versions"))

