"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: What the last tables written here were made of, by path, for lineage.
_MADE_OF: OrderedDict[str, DataFrame] = OrderedDict()
KEPT = 500


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as a cluster names it; a temporary folder only for local sessions that leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='medlattice-')}")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a table in the shared folder: what is read twice stays the same, also when executors are lost."""
    at = fresh_path(df.sparkSession, tag)
    df.write.parquet(at)
    _MADE_OF[at.rpartition("/")[2]] = df
    while len(_MADE_OF) > KEPT:
        _MADE_OF.popitem(last=False)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def made_of(folder: str) -> DataFrame | None:
    """The rows that written() put in a folder of this name, if they are remembered."""
    return _MADE_OF.get(folder)
