"""The plans that the verbs should lead to, and every query against DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from docweft import LazyTable, desc
from docweft.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return LazyTable.from_df(spark.read.parquet(f"{SF}/orders.parquet"), "orders")


def test_filters_and_columns_reach_the_scan(orders):
    text = plan(orders.filter("o_totalprice > 100").mutate(z="o_totalprice * 2").arrange("o_orderkey").slice_head(3).select("z").to_df())
    assert "GreaterThan(o_totalprice,100" in text
    assert "o_orderpriority" not in text


def test_head_is_a_bounded_sort(orders):
    assert "TakeOrderedAndProject" in plan(orders.arrange(desc("o_totalprice")).slice_head(5).to_df())


def test_groups_combine_before_the_shuffle(orders):
    assert "partial_sum" in plan(orders.group_by("o_custkey").summarise(s="sum(o_totalprice)").to_df())


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    other = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    at = [other.columns.index(c) for c in df.columns]
    key = lambda row: [(x is None, str(x)) for x in row]
    ours = sorted((tuple(same(v) for v in r) for r in df.collect()), key=key)
    theirs = sorted((tuple(same(r[i]) for i in at) for r in other.fetchall()), key=key)
    assert ours == theirs
