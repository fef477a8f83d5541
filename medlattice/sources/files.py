"""Trial files and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import EDC_ITEMS, SUBJECTS


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """A file with a header and a fixed schema; blanks stay empty texts, not nulls; quotes in quoted values are doubled."""
    df = spark.read.csv(path, header=True, schema=schema, nullValue="\0", emptyValue="", escape='"', enforceSchema=False)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def read_items(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Long trial items with ord, their place in the input (by file block and position in it)."""
    return read_csv(spark, path, EDC_ITEMS).withColumn("ord", F.monotonically_increasing_id())


def read_subjects(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return read_csv(spark, path, SUBJECTS)


def typed(df: DataFrame, dates: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Columns as dates or numbers, null where a text is none."""
    kinds = {c: "date" for c in dates} | {c: "double" for c in numbers}
    return df.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for reports of bounded size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary_rows(measures: dict[str, DataFrame]) -> DataFrame:
    """(metric, label, value) of small (label, value) tables, for the board."""
    out = None
    for name, df in measures.items():
        row = df.toDF("label", "value").select(F.lit(name).alias("metric"), F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
