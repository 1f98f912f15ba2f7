"""Every registered query against its SQL equivalent on the smallest sample tables."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from attestra.plans import oracle
from attestra.plans.queries import REGISTRY

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_an_equivalent():
    assert set(oracle.statements()) == set(REGISTRY)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    df = REGISTRY[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(oracle.statements()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    mine = Counter(tuple(str(row[c]) for c in columns) for row in df.collect())
    theirs = Counter(tuple(str(row[order.index(c)]) for c in columns) for row in cursor.fetchall())
    assert mine == theirs
