"""Document readers: line-delimited JSON and bundles as rows, with what can't be read as rows too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .schemas import RESOURCE_TYPES

#: Characters of an unreadable line that are kept.
RAW_CHARS = 4000
COLUMNS = ("payload", "source_ref", "line_number", "parse_error", "raw_text")


def _checked(text: Column) -> Column:
    """Why a text is no JSON object, or null."""
    return (
        F.when(~F.is_valid_utf8(text), "line is not valid UTF-8")
        .when(F.try_parse_json(F.make_valid_utf8(text)).isNull(), "line is not valid JSON")
        .when(~F.ltrim(text).startswith("{"), "resource is not a JSON object")
    )


def _rows(df: DataFrame, *more: str) -> DataFrame:
    df = df.withColumn("parse_error", _checked(F.col("text")))
    return df.select(
        F.when(F.col("parse_error").isNull(), F.col("text")).alias("payload"), "source_ref", "line_number", "parse_error",
        F.when(F.col("parse_error").isNotNull(), F.left(F.make_valid_utf8(F.col("text")), F.lit(RAW_CHARS))).alias("raw_text"), *more,
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A row for each line of line-delimited JSON that isn't blank; unreadable lines keep parse_error and the raw text.

    line_number counts within the file: lines are written with their place in what one task reads, and a block's first place and size give
    the base of its lines, so that a large file is never gathered in one task and no line is shuffled.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_ref"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    lines = written(lines, "lines")
    blocks = lines.groupBy("source_ref", "_block").agg(F.min("_id").alias("_begin"), F.count("*").alias("_size"))
    before = Window.partitionBy("source_ref").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("source_ref", "_block", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_begin") + 1).alias("_base"))  # a row for each block that was read
    placed = lines.join(F.broadcast(base), ["source_ref", "_block"]).select(F.col("value").alias("text"), "source_ref", (F.col("_base") + F.col("_id")).alias("line_number"))
    return _rows(placed.where(F.trim(F.make_valid_utf8(F.col("text"))) != ""))


def read_bundles(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A row for each entry of a Bundle (numbered from 1), or for the one document that a file holds. A bundle whose `entry` isn't
    an array, and an entry without a resource, are error rows."""
    files = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_ref"))
    files = files.withColumn("_why", _checked(F.col("text")))
    parsed = files.withColumn("_b", F.when(F.col("_why").isNull(), F.from_json("text", "resourceType string, entry string")))
    bundle = F.col("_why").isNull() & (F.col("_b.resourceType") == "Bundle")
    listed = F.coalesce(F.ltrim(F.col("_b.entry")), F.lit("[]")).startswith("[")
    one = parsed.where(~F.coalesce(bundle, F.lit(False))).select("text", "source_ref", F.lit(1).cast("long").alias("line_number"))
    bad = parsed.where(bundle & ~listed).select(F.lit(None).cast("string").alias("payload"), "source_ref", F.lit(1).cast("long").alias("line_number"), F.lit("bundle entry is not an array").alias("parse_error"), F.left(F.col("text"), F.lit(RAW_CHARS)).alias("raw_text"))
    entries = parsed.where(bundle & listed).select("source_ref", F.posexplode(F.from_json(F.coalesce("_b.entry", F.lit("[]")), "array<struct<resource:string>>")).alias("_i", "_e"))
    entries = entries.select(F.col("_e.resource").alias("text"), "source_ref", (F.col("_i") + 1).cast("long").alias("line_number"))
    missing = entries.where("text is null").select(F.lit(None).cast("string").alias("payload"), "source_ref", "line_number", F.lit("bundle entry has no resource").alias("parse_error"), F.lit(None).cast("string").alias("raw_text"))
    return _rows(one).unionByName(_rows(entries.where("text is not null"))).unionByName(bad).unionByName(missing)


def read_directory(spark: SparkSession, directory: str, types: Sequence[str] = RESOURCE_TYPES) -> DataFrame:
    """All `Type*.ndjson` and `Type*.json` files of the given types; other files are never opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    names = [s.getPath() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    wanted = sorted((t, p.toString()) for p in names for t in [p.getName().split(".")[0]] if t in types)
    lines = [p for _, p in wanted if p.endswith(".ndjson")]
    whole = [p for _, p in wanted if p.endswith(".json")]
    parts = ([read_lines(spark, lines)] if lines else []) + ([read_bundles(spark, whole)] if whole else [])
    if not parts:
        return spark.createDataFrame([], "payload string, source_ref string, line_number long, parse_error string, raw_text string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def count_by_type(rows: DataFrame) -> DataFrame:
    """Rows by document type, with `(unparsed)` and `(untyped)`."""
    kind = F.get_json_object("payload", "$.resourceType")
    return rows.groupBy(F.when(F.col("payload").isNull(), "(unparsed)").otherwise(F.coalesce(kind, F.lit("(untyped)"))).alias("resource_type")).agg(F.count("*").alias("n"))
