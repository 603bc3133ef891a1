"""Every catalogued query against its SQL in DuckDB."""

import duckdb
import pytest

from colstate.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


def sql_rows(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got
    if name in catalogue.ORACLES:
        names, want = sql_rows(catalogue.ORACLES[name])
        assert cols == names
        assert got == want
