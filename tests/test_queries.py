import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect
from trainscope.oracles import statements
from trainscope.plans.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STORED = {"hang_verdicts", "alert_rollup", "alert_messages", "alert_marks", "event_store_day"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(statements())


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_") and n not in STORED])
def test_plans_stay_distributed(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert bad not in plan


def test_tail_keeps_few_lines_before_each_shuffle(spark):
    plan = plan_of(spark, "log_tail")
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial)") + plan.count("Partial") >= 2


def test_parsing_runs_after_the_tail(spark):
    plan = plan_of(spark, "suspend_seconds")
    assert plan.index("regexp_extract") < plan.rindex("WindowGroupLimit")


def test_scans_read_only_needed_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = plan_of(spark, "request_totals")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan
