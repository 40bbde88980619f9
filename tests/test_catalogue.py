"""Every query of the core on the smallest tables, beside its SQL where there is one."""

import math
from pathlib import Path

import duckdb
import pytest

from labelloom.plans import catalogue, contract_queries, data_queries, engine_queries, structure_queries

QUERIES = {**catalogue.QUERIES, **data_queries.QUERIES, **engine_queries.QUERIES, **structure_queries.QUERIES, **contract_queries.QUERIES}
SQL = {**catalogue.SQL, **data_queries.SQL, **engine_queries.SQL, **structure_queries.SQL, **contract_queries.SQL}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        out = con.execute(SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_most_checks_fail_somewhere(con):
    """The derived form breaks nearly every check, so agreement with the SQL says something about each."""
    failed = {r[0] for r in con.execute(SQL["contract_failures"]).fetchall()}
    assert len(failed) >= 45
