"""Every named query next to its SQL in an independent engine."""

import duckdb
import pytest
from check_oracles import TABLES, differences

from __spark_entry__ import entry
from linkrec.plans.catalog import QUERIES
from linkrec.plans.oracles import ORACLES

DIR = "/root/testdata/sf0.001"
NO_SQL = {
    "tree_audit",
    "tree_scores",
    "stacked_scores",
    "validation_report",
    "recommend_end_to_end",
    "recommend_text_to_text",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_all_but_models_have_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    rel = db.sql(ORACLES[name])
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert differences(df.toPandas(), rel.df(), dict(df.dtypes), types) == []


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_model_queries_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "friend_id", "score", "rank"]
    assert df.count() > 0
