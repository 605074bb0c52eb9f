import os

import duckdb
import pytest

from barloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.execute(queries.ORACLES[name]).df()
    expected = expected.sort_values(expected.columns[0]).reset_index(drop=True).astype(object)
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert set(got.columns) == set(expected.columns)
    got = got.sort_values(expected.columns[0]).reset_index(drop=True)[expected.columns].astype(object)
    expected, got = expected.where(expected.notna(), None), got.where(got.notna(), None)
    for column in expected:
        if any(isinstance(v, float) for v in expected[column]):
            assert got[column].tolist() == pytest.approx(expected[column].tolist(), rel=1e-12)
        else:
            assert got[column].tolist() == expected[column].tolist()
