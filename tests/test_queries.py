"""Every registered query of the library against its SQL, and the contract of the entry module."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from tiermem import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from '{p}'")
    return con


def _rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def _same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = _rows([r[c] for c in cols] for r in df.collect())
    found = db.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = _rows([dict(zip(names, r, strict=True))[c] for c in cols] for r in found.fetchall())
    assert len(got) == len(want)
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
