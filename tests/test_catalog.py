"""Every catalog query against its SQL counterpart on the smallest tables, and plan checks."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_sql import kinds, rows
from codeassay.plans.catalog import QUERIES
from codeassay.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items() and ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    relation = tables.sql(ORACLES[name])
    assert kinds(dict(df.dtypes)) == dict(zip(relation.columns, map(str, relation.types)))
    assert rows(df.toPandas()) == rows(relation.df())


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


NATIVE = ["failure_modes", "quick_score", "compliance_issues", "failure_mode_distribution", "score_distribution", "batch_summary",
          "test_verdict", "response_regressions", "report_counts", "report_dedup_first", "job_latest_status",
          "extract_fenced", "spec_conformance", "rules_effective"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_start_no_python(spark, name):
    assert "EvalPython" not in plan(spark, name)


@pytest.mark.parametrize("name", ["failure_modes", "quick_score", "extract_cascade", "compliance_score", "threshold_pass", "syntax_audit"])
def test_projections_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["extract_cascade", "compliance_score", "threshold_pass"])
def test_one_python_pass(spark, name):
    assert plan(spark, name).count("ArrowEvalPython") == 1


@pytest.mark.parametrize(
    "name, columns",
    [
        ("response_regressions", "doc_id:bigint,quality:int,toxic:int"),
        ("job_latest_status", "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string"),
        ("report_counts", "c_custkey:bigint,c_nationkey:int,c_acctbal:double"),
    ],
)
def test_scans_read_only_needed_columns(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
