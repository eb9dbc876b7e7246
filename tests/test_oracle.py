"""Every registered query against its SQL oracle (DuckDB) on the smallest scale."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "scripts"))
import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, rows_of, type_diff  # noqa: E402

NAMES = sorted(set(E.queries()) - set(E.LLM_QUERIES))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "avg_sentiment" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    frame = E.queries()[name](spark, SF_SMALL)
    sdf = frame.toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no SQL oracle; covered by hand fixtures")
    assert type_diff(frame, con, sql) == {}
    odf = con.execute(sql).df()
    sc, sr = rows_of(sdf)
    oc, orows = rows_of(odf)
    assert sc == oc
    assert len(sr) == len(orows)
    assert sr == orows
