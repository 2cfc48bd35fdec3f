"""Every registered query against its SQL, and rules every plan keeps."""

import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regionlens.functions import materialize
from regionlens.plans.registry import CASES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v) if isinstance(v, float) else str(v)


def check_plan(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert not re.match(r"\s*(specifiedwindowframe|\w+#\d+L? (ASC|DESC))", spec), f"window without keys: {spec}"


@pytest.fixture(autouse=True)
def watched():
    """Plans are also checked where a step is written."""
    materialize.WATCHERS.append(check_plan)
    yield
    materialize.WATCHERS.remove(check_plan)


@pytest.mark.parametrize("name", sorted(CASES))
def test_query(name, spark, sf_dir, con):
    df = entry.queries()[name](spark, sf_dir)
    check_plan(df)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = con.execute(sql)
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "state" and df.count() > 0


def test_scans_read_needed_columns(spark, sf_dir):
    plan = entry.queries()["mrt3_success_rate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any(s.startswith("l_orderkey") for s in schemas)
    assert all("l_extendedprice" not in s and "o_totalprice" not in s for s in schemas)


def test_repeats_are_pruned_before_the_shuffle(spark, sf_dir):
    plan = entry.queries()["cln10_drop_repeats"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index(", Partial"), plan.index("hashpartitioning(date")
    assert plan.index(", Final") < exchange < partial


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz"])
def test_date_filter_reaches_the_scan(spark, sf_dir, tmp_path, kind):
    from regionlens.operators.marts import filter_facts
    from regionlens.sources.adapters import trade_fact

    path = str(tmp_path / "facts")
    trade_fact(spark, sf_dir).withColumn("date", F.col("date").cast(kind)).write.parquet(path)
    df = filter_facts(spark.read.parquet(path), ("1996-01-01", "1996-12-31"), ["NATION_1"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed and "EqualTo(state,NATION_1)" in pushed
    assert {r[0].year for r in df.select("date").distinct().collect()} == {1996}
