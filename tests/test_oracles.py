"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import os

import duckdb
import pytest

from leakdrift.plans.registry import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if x is None else str(x) if not isinstance(x, float) else f"{x:.6f}" for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.execute(f"select {', '.join(columns)} from ({ORACLES[name]}) q").fetchall()
    got = [tuple(r[c] for c in columns) for r in found.collect()]
    assert plain(got) == plain(want)
