"""Every query that has SQL gives DuckDB's rows on the smallest tables; those without run. The corpus operators have their own tests."""

import duckdb
import pytest

from boardfoot.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert rows
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(tuple(map(text, r)) for r in rows) == sorted(tuple(text(r[i]) for i in at) for r in got.fetchall())
