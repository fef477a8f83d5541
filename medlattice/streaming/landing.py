"""Documents as a stream: repeats dropped within a watermark, validated in micro-batches, landed exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gate import divided, judged
from ..operators.tables import land
from ..plans.warehouse import DOCUMENT, LANDED
from ..sources.documents import _rows
from ..sources.schemas import GATE
from ..sources.snapshots import Load, Store


def without_repeats(rows: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed its expiry, the time of its first row plus `within`.

    What the state holds is bounded by the keys of that time. A repeat that comes later passes, and rows older than the watermark go:
    what must never come twice needs a check of the target as well (land_stream has both).
    """
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of a folder's files as they come, as sources.documents gives them, with the time of the file (arrived). Line numbers aren't
    known in a stream; source_ref is the file."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
    lines = lines.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_ref"), F.lit(None).cast("long").alias("line_number"), F.col("_metadata.file_modification_time").alias("arrived"))
    return _rows(lines.where(F.trim("text") != ""), "arrived")


def drained(rows: DataFrame) -> None:
    """Reads a micro-batch for nothing but the state of the stream's operators, which Spark wants written for each batch."""
    rows.write.format("noop").mode("overwrite").save()


def land_batch(store: Store, rows: DataFrame, stream: str, number: int, kind: str = "bulk") -> None:
    """One micro-batch as one load. Its number is part of the manifest: a batch that comes again after a failure is left out whole,
    landed rows and rejects alike."""

    def work(load: Load) -> None:
        if load.base.streams.get(stream, -1) >= number:
            drained(rows)
            return
        got = load.scratch("judged", judged(rows))
        accepted, rejected = divided(got)
        fresh, twice = land(load.read("raw.document", DOCUMENT), accepted, LANDED, [F.col("last_updated").desc_nulls_last(), F.col("source_ref")])
        mine = F.lit(load.id).alias("batch_id")
        landed = load.append("raw.document", fresh.select("*", mine), "resource_type", unique=True)
        rejects = load.append("stg.rejects", rejected.select("*", mine))
        load.counts = {"n_read": got.count(), "n_accepted": landed.count(), "n_rejected": rejects.count()}
        load.counts["n_duplicate"] = load.counts["n_read"] - load.counts["n_accepted"] - load.counts["n_rejected"]
        load.streams[stream] = number

    store.transact(kind, work)


def land_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, files_per_batch: int = 100, within: str | None = None, stream: str = "landing") -> StreamingQuery:
    """Lands what the folder holds and ends (availableNow); run again, it takes what is new. within: repeats of a document version that
    come so soon after it are dropped before they are validated; later ones find their key in the target."""
    rows = read_stream(spark, folder, files_per_batch)
    if within:
        g = F.from_json("payload", GATE)
        ours = g["id"].isNotNull() & F.col("parse_error").isNull()
        key = F.when(ours, F.concat_ws("|", g["resourceType"], g["id"], F.coalesce(g["meta"]["versionId"], F.lit("1")))).otherwise(F.concat_ws("|", "source_ref", F.sha2(F.coalesce("payload", "raw_text"), 256)))
        rows = without_repeats(rows.withColumn("repeat_key", key), ["repeat_key"], "arrived", within).drop("repeat_key")
    rows = rows.drop("arrived")
    return rows.writeStream.foreachBatch(lambda df, number: land_batch(store, df, stream, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pull_stream(spark: SparkSession, options: dict[str, str], store: Store, checkpoint: str, stream: str = "pull") -> StreamingQuery:
    """Lands what a REST server has changed since the checkpoint's last offset (sources.rest), and ends."""
    rows = spark.readStream.format("rest_search").options(**options).load().drop("mode")
    return rows.writeStream.foreachBatch(lambda df, number: land_batch(store, df, stream, number, "rest")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum for each window and type; events later than the watermark are left out. Works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
