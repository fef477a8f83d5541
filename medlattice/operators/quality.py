"""Data-quality checks: a registry of queries that give no rows when all is well, and its runner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def null_rate(df: DataFrame, column: str, name: str) -> DataFrame:
    n, nulls = F.count("*"), F.count_if(F.col(column).isNull())
    return df.agg(n.alias("n"), nulls.alias("nulls")).select(F.lit(name).alias("column_name"), "n", "nulls", ratio(F.col("nulls"), F.col("n")).alias("rate"))


@dataclass(frozen=True)
class Check:
    check_id: str
    severity: str
    description: str
    failures: Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Outcome:
    check_id: str
    severity: str
    n_failures: int
    sample: list
    error: str = ""


def run_checks(checks: list[Check], tables: dict[str, DataFrame], sample: int = 20) -> list[Outcome]:
    """Counts each check's failures and keeps a few rows of them. A check that can't run counts as failed."""
    out = []
    for c in checks:
        try:
            rows = c.failures(tables)
            n = rows.count()
            out.append(Outcome(c.check_id, c.severity, n, rows.limit(sample).collect() if n else []))
        except Exception as e:
            out.append(Outcome(c.check_id, c.severity, -1, [], f"{type(e).__name__}: {str(e)[:300]}"))
    return out


def passed(outcomes: list[Outcome]) -> bool:
    """True unless a check of severity error has failures or could not run."""
    return not any(o.severity == "error" and o.n_failures for o in outcomes)
