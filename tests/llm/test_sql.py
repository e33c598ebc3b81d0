"""The training-data queries against their SQL on the test tables."""

import duckdb
import pytest
from conftest import DATA

from graphloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    got = plain(df.select(cols).collect())
    assert got == plain(duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({queries.SQL[name]})").fetchall())
