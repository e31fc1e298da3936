"""Queries of the baseline where the table ends within a stream, against their SQL; and the operator by itself, which goes by the stream's own end."""

import duckdb
import pytest

from tiermem import registry
from tiermem.operators import baseline
from tiermem.plans import fixtures

from .test_queries import SF, _rows, _same

NAMES = ["bas_answer", "bas_context", "bas_stats", "bas_topk", "run_records", "run_records_plain"]


@pytest.fixture(scope="module")
def short(tmp_path_factory):
    """Two whole streams and 56 windows of a third, which ends before three of its questions."""
    d = tmp_path_factory.mktemp("short")
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 256) TO '{d}/embeddings.parquet'")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, short, name):
    df = registry.QUERIES[name](spark, short)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{short}/embeddings.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = _rows([dict(zip(names, r, strict=True))[c] for c in cols] for r in found.fetchall())
    got = _rows([r[c] for c in cols] for r in df.collect())
    assert len(got) == len(want) and any(str(r[cols.index("question_id")]).startswith("2-") for r in got)
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_late_question_of_a_short_stream_has_its_last_windows(spark, short):
    r = fixtures.retrieval(spark, short)
    got = {x.window_id for x in baseline.context(r.fired, r.windows, fixtures.CONFIG).where("question_id = '2-2'").collect()}
    assert got == {f"w-{i}" for i in range(246, 256)}
