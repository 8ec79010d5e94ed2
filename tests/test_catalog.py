"""All named queries against their SQL in DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillon import catalog

SF = Path("/root/testdata/sf0.001")
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order) for v in values)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(SF))
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, want.fetchall())


def test_every_oracle_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_what_is_not_done_has_no_query():
    gone = {"fn_nilsimsa_compare", "ctx_composition", "auth_value_match", "hist_ctx_revisions", "xu_insert_before", "xu_insert_after"}
    assert not gone & set(catalog.queries()) and not gone & set(catalog.oracle_sql())
