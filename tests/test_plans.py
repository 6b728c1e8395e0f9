"""Plan properties of every registered query: no pair-producing joins,
filters and column pruning reach the scans."""

import re

import pytest

import __spark_entry__ as E
from chatlore.queries import QUERIES
from conftest import SF_SMALL

STREAMING = {"chat_stream", "ingest_stream"}  # their result is a file-sink read


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_loader_scans_prune_columns_and_push_filters(spark):
    plan = E.queries()["build_documents"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet [^\n]*", plan)
    assert scans
    for scan in scans:
        schema = re.search(r"ReadSchema: struct<([^\n]*)>", scan).group(1)
        assert "c_acctbal" not in schema and "c_mktsegment" not in schema
    assert any("EqualTo(turn,0)" in s for s in scans)


@pytest.mark.parametrize("name", ["channel_recent_cap", "cap_before_filter", "retrieve_topk"])
def test_group_limits_run_map_side(spark, name):
    """A channel or question with a third of all rows ships only k rows per
    map task: the limit runs before the shuffle (Partial) and after it (Final)."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan), plan
    assert re.search(r"WindowGroupLimit .*Final", plan), plan


@pytest.mark.parametrize("name", ["run_metrics", "embed_documents", "build_documents", "embed_documents_sql"])
def test_building_a_plan_starts_no_job(spark, name):
    """Reading a table's schema is the only work done to build these plans."""
    E.queries()[name](spark, SF_SMALL)  # schemas
    tracker = spark.sparkContext.statusTracker()
    group = f"plan-{name}"
    spark.sparkContext.setJobGroup(group, "plan only")
    try:
        from chatlore.operators import parallel

        derived = spark.range(100).groupBy("id").count()
        before = set(tracker.getJobIdsForGroup(group))
        parallel.spread(derived)
        assert set(tracker.getJobIdsForGroup(group)) == before
        plan = E.queries()[name](spark, SF_SMALL)
        scans = plan._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
        assert len(set(tracker.getJobIdsForGroup(group)) - before) <= scans  # one schema read a scan at most
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sql_embedder_needs_no_exchange(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    from chatlore.operators.embed import hash_embed_sql

    assert "Exchange" not in hash_embed_sql(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()


def test_chat_plan_stays_narrow(spark):
    """Half the exchanges of a plan that joins answers before counting."""
    plan = E.queries()["chat_batch"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8, plan
