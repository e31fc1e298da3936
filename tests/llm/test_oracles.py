"""Corpus queries against their SQL, over whole small tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from tiermem.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in found.fetchall()), key=key)
