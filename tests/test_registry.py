"""Registered queries against their DuckDB oracles on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from barloom.registry import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v != v:
                cells.append("NULL")
            elif hasattr(v, "isoformat"):
                cells.append(v.isoformat())
            else:
                cells.append(f"{float(v):.12g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, db, name):
    got = contract.queries()[name](spark, SF).toPandas()
    expected = db.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(math.isfinite(r.net) for r in rows)
