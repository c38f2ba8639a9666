import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from mosaiq.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    def cell(x):
        if x is None or x != x:
            return None
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_oracle(spark, con, name):
    df, o = catalog.QUERIES[name](spark, SF), con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(o.columns)
    names = sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(o.select(*(f'"{n}"' for n in names)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_verify_matrix_finds_each_spoiled_field(spark):
    want = {0: set(), 1: {"schema_ok"}, 2: {"algorithm_ok"}, 3: {"payload_ok"}, 4: {"key_ok"}, 5: {"tag_ok"}}
    for r in catalog.verify_matrix(spark, SF).collect():
        assert {c for c in ("schema_ok", "algorithm_ok", "payload_ok", "key_ok", "tag_ok") if not r[c]} == want[r["case"]]


def test_filters_reach_the_scan(spark):
    plan = catalog.runtime_by_stage(spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "ReadSchema" in plan
    assert "c_name" not in plan
