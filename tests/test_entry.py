"""Driver contract: entry(), queries() and their DuckDB twins at sf0.001."""

import uuid

import pytest

import __spark_entry__ as E
import oracle_harness as OH
from chatlore.config import Params
from chatlore.oracle_queries import ORACLE
from chatlore.plans import ingest as P_ingest
from chatlore.queries import QUERIES
from chatlore.session import scratch_path
from chatlore.sources import views
from chatlore.sources.vector_index import VectorIndex
from conftest import SF_SMALL



def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    return OH.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    r = OH.compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, duck)
    assert r["cols_match"], r
    assert r["rows"][0] == r["rows"][1], r
    assert r["hash_match"], r


def test_reingest_is_a_noop(spark):
    index = VectorIndex(spark, scratch_path(spark, f"test-ingest-{uuid.uuid4().hex}"))
    args = (views.messages(spark, SF_SMALL), views.replies(spark, SF_SMALL), views.users(spark, SF_SMALL), index)
    assert P_ingest.ingest(*args) == 1
    n = index.count()
    assert P_ingest.ingest(*args) is None  # every (id, content) already indexed
    assert index.count() == n and index.versions() == [1]
    assert n == views.messages(spark, SF_SMALL).where("subtype IS NULL OR subtype = ''").count()


def test_ingest_error_policy_fail_fast(spark):
    index = VectorIndex(spark, scratch_path(spark, f"test-ingest-{uuid.uuid4().hex}"))

    def broken():
        def fn(texts):
            raise RuntimeError("model unavailable")
        return fn

    with pytest.raises(Exception):
        P_ingest.ingest(views.messages(spark, SF_SMALL), views.replies(spark, SF_SMALL),
                        views.users(spark, SF_SMALL), index, Params(), embedder=broken)
    assert index.current_version() is None  # all channels or none


def test_ingest_observation_counters(spark):
    from pyspark.sql import Observation

    index = VectorIndex(spark, scratch_path(spark, f"test-ingest-{uuid.uuid4().hex}"))
    obs = Observation("ingest")
    P_ingest.ingest(views.messages(spark, SF_SMALL), views.replies(spark, SF_SMALL),
                    views.users(spark, SF_SMALL), index, observation=obs)
    m = obs.get
    assert m["documents"] == index.count() == m["embedded"] and m["failed"] == 0 and m["dimensions"] == 64


def test_loader_has_no_python_stage(spark):
    docs = E.queries()["build_documents"](spark, SF_SMALL)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    for node in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert node not in plan
