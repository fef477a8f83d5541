"""The library's rules as temporary SQL functions; Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ID = """CASE WHEN ref LIKE '%?%' THEN NULL WHEN ref LIKE 'urn:uuid:%' THEN substr(ref, 10) WHEN ref LIKE '%/%' THEN substring_index(ref, '/', -1) END"""

#: name -> (parameters, result, body)
FUNCTIONS = {
    "reference_id": ("ref STRING", "STRING", _ID),
    "age_years": ("birth DATE, as_of DATE", "INT", "year(as_of) - year(birth)"),
    "coded_term": ("verbatim STRING", "STRING", "regexp_replace(lower(trim(verbatim)), '[^a-z0-9 ]', '')"),
    "minutes_passed": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "(unix_seconds(date_trunc('MINUTE', b)) - unix_seconds(date_trunc('MINUTE', a))) div 60"),
}


def register(spark: SparkSession) -> None:
    """Adds the scalar functions, and reference_ids(ref) as a table function for LATERAL joins."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION reference_ids(ref STRING) RETURNS TABLE(id STRING) RETURN SELECT {_ID}")
