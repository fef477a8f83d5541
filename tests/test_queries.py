"""Every query of the library against its SQL, at the smallest size."""

import glob
import os

import duckdb
import pytest

from medlattice import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    def plain(v):
        if hasattr(v, "isoformat"):
            return v.isoformat().replace("T00:00:00", "")
        return round(v, 6) if isinstance(v, float) else v

    return names, sorted((tuple(plain(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, oracle, name):
    assert rows(registry.QUERIES[name](spark, SF).toArrow()) == rows(oracle.execute(registry.SQL[name]).to_arrow_table())


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
