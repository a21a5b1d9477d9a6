"""The operators that SQL can say give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from boardfoot.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = con.execute(ORACLES[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(tuple(r[i] for i in at) for r in got.fetchall())
