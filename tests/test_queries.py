"""The registered engine queries against their SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from policylog import queries as engine_queries

SF = "/root/testdata/sf0.001"
SQL = engine_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = engine_queries.queries()[name](spark, SF)
    want = duck.execute(SQL[name]).fetchall()
    columns = [d[0] for d in duck.description]
    assert set(columns) == set(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))


def test_explanations(spark):
    lines = [r.text for r in sorted(engine_queries.explain_text(spark, SF).collect())]
    assert lines[2] == "status=complete" and lines[-1].startswith("result-step=")
    assert engine_queries.proof(spark, SF).count() == 64


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["c", "nn", "rn"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
