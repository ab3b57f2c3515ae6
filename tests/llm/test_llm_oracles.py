"""The text queries with SQL against DuckDB on the smallest tables."""

import pytest

from tallymatch.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda names, found: sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in sorted(range(len(names)), key=lambda i: names[i])) for r in found)
    assert plain(df.columns, df.collect()) == plain(columns, want.fetchall())
