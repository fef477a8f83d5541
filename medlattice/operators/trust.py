"""A catalogue of the declared constraints with what is known of them: whether rows were checked since they last changed, and the result.

Parquet enforces nothing, so a constraint is trusted only for the version of its tables that was checked. The catalogue is a table of the
snapshot store; a later load of a table (or of a foreign key's parent) makes its constraints untrusted again, without anything to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshot, Store
from . import constraints

CATALOG = "meta.constraint"
_ROW = "constraint_name string, table_name string, parent_name string, kind string, n_rows long, validated_version long"


def declared(tables: list[str]) -> list[tuple[str, str, str | None, str]]:
    """(constraint, table, parent, kind) of every constraint whose tables are there."""
    there = set(tables)
    out: list[tuple[str, str, str | None, str]] = [(n, t, None, "check") for t, n, _ in constraints.CHECKS if t in there]
    out += [(f"{column} -> {parent}", child, parent, "foreign key") for child, column, parent, _ in constraints.FOREIGN_KEYS if child in there and parent in there]
    return out + [(f"unique ({', '.join(keys)})", t, None, "key") for t, keys in constraints.KEYS.items() if t in there]


def stored(name: str) -> str:
    """The store's name of a table: dimensions are stored without their Unknown member."""
    return f"dim.{name[3:]}" if name.startswith("dw.") else name


def validate(store: Store, tables: dict[str, DataFrame]) -> DataFrame:
    """Checks every constraint over the tables of the newest version, keeps the results in the catalogue, and returns it."""
    version = store.snapshot().version
    found = constraints.check_violations(tables).unionByName(constraints.key_violations(tables))
    rows = store.spark.createDataFrame([(*c, version) for c in declared(list(tables))], "constraint_name string, table_name string, parent_name string, kind string, validated_version long")
    out = rows.join(found, ["constraint_name", "table_name"], "left").select("constraint_name", "table_name", "parent_name", "kind", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "validated_version")
    store.transact("validate", lambda load: load.write(CATALOG, out))
    return store.read(CATALOG)


def _changed(now: Snapshot, name: str | None) -> int:
    return now.tables[stored(name)].version if name and stored(name) in now else 0


def states(store: Store, tables: list[str]) -> DataFrame:
    """(constraint_name, table_name, kind, state, n_rows, validated_version, changed_version) as of the newest version.

    untrusted: never checked, or its table or parent has changed since; violated: checked, and n_rows break it; trusted: checked, and
    none does. A table that the store doesn't keep counts as unchanged.
    """
    now = store.snapshot()
    known = [(n, t, kind, max(_changed(now, t), _changed(now, p))) for n, t, p, kind in declared(tables)]
    rows = store.spark.createDataFrame(known, "constraint_name string, table_name string, kind string, changed_version long")
    seen = now.read(CATALOG, _ROW).select("constraint_name", "table_name", "n_rows", "validated_version")
    fresh = F.coalesce(F.col("validated_version") >= F.col("changed_version"), F.lit(False))
    state = F.when(~fresh, "untrusted").when(F.col("n_rows") > 0, "violated").otherwise("trusted")
    return rows.join(seen, ["constraint_name", "table_name"], "left").select("constraint_name", "table_name", "kind", state.alias("state"), "n_rows", "validated_version", "changed_version")
