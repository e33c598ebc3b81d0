"""Every catalogue query against its SQL on the test tables."""

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__  # noqa: F401  registers all queries
from graphloom.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


def in_order(rows):
    """Rows as tuples in one order, nulls first."""
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is not None, v) for v in r])


#: Queries that SQL does not express; see README for how each is tested.
EXACT_ELSEWHERE = {"fuzzy_topk", "evidence_search", "legacy_search", "dual_level_search", "deep_search", "duplicate_titles", "louvain", "whole_evidence_search"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == EXACT_ELSEWHERE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = in_order(df.select(cols).collect())
    assert got
    if name in SQL:
        want = in_order(duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({SQL[name]})").fetchall())
        assert len(got) == len(want)
        assert got == want
