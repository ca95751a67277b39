"""Registered queries against DuckDB, and the shape of their plans."""

import os

import pytest

import __spark_entry__
from checks import compare, fixtures
from checks.queries import ORACLE, QUERIES
from corpuscope import extract_features
from corpuscope.session import materialize

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# The quick ones, and for every stage of the audit the one that shows most of it.
CHOSEN = (
    "skipped_count record_projection sort_inventory decode_text page_rules sheet_text layout_warnings extract_dispatch "
    "text_fingerprint garbled_ratio risk_bank_card risk_email rule_layout accumulate_findings finalize_verdicts "
    "duplicate_components elect_primary version_families topic_scores absorb_tiny_topics cap_topics report_datasets"
).split()


def test_registry_is_complete():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_duckdb(spark, name):
    verdict, *_ = compare.compare(spark, compare.duck(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER)
    assert verdict.startswith("ok"), verdict


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_narrow_stage_without_text_in_python(spark):
    from corpuscope.sources.tables import read_table

    query, sources = fixtures._SOURCES["corpus"]
    # One table, as a user has it: over a union Spark would plan the stage once per branch.
    docs = materialize(spark.sql(query, **{x: read_table(spark, FOLDER, x) for x in sources}), "corpus")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = plan_of(extract_features(docs, fixtures.AS_OF))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    line = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    arguments = line[line.index("ArrowEvalPython") :]
    assert "odd_text" in arguments and " text#" not in arguments


def test_projection_prunes_the_scan(spark):
    df = QUERIES["content_length"](spark, FOLDER)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_reports_use_no_nested_loops(spark):
    for name in ("problem_examples", "conclusions", "topic_plan"):
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "WindowGroupLimit" in plan_of(QUERIES["problem_examples"](spark, FOLDER))
