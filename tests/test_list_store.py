"""Stored inverted lists: the rows of the exact search, no training at query time, files pruned."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlore.operators import knn
from chatlore.session import scratch_path
from chatlore.sources import list_store
from chatlore.sources.list_store import ListStore


def fresh(spark, **options):
    return ListStore(spark, scratch_path(spark, f"lists-{uuid.uuid4().hex}"), **options)


def frame(spark, vectors, name="id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 f"{name} long, embedding array<double>")


def clustered(seed=3, clusters=12, each=40, dim=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim)) * 30
    return np.concatenate([c + rng.normal(size=(each * (1 + 4 * (i == 0)), dim)) for i, c in enumerate(centers)])


def got(df):
    return sorted((r["question_id"], r["rank"], r["id"], round(r["distance"], 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_rows_of_the_exact_search(spark, metric, limit):
    m = clustered()
    m[5] = 0                                     # no direction
    m[20:30] = m[20]                             # ties
    corpus = frame(spark, [*m, None])
    questions = frame(spark, [*m[::25], np.zeros(8), None], "question_id")
    store = fresh(spark, metric=metric, max_broadcast_bytes=limit)
    store.build(corpus, n_lists=16)
    found = store.topk(questions, k=4, max_group_rows=50, max_group_questions=3)
    assert got(found) == got(knn.topk(questions, corpus, k=4, metric=metric))


def test_only_the_lists_in_reach_are_read_and_nothing_is_trained(spark, monkeypatch):
    m = clustered()
    store = fresh(spark)
    store.build(frame(spark, m), n_lists=16)

    def no_training(*_, **__):
        raise AssertionError("a search trains nothing")

    monkeypatch.setattr(list_store, "KMeans", no_training)
    again = ListStore(spark, store.path)
    found = again.topk(frame(spark, m[400:402], "question_id"), k=3)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_list" in plan or "PartitionFilters: [_list" in plan
    read = again.last_read
    assert 0 < read.files < read.all_files and read.rows < read.all_rows / 2 and read.all_rows == len(m)
    opened = {f.split("/")[-2] for f in spark.read.parquet(f"{store.path}/v=1/rows").inputFiles()}
    assert len(opened) == read.all_lists
    assert found.count() == 6


def test_versions_and_a_build_that_failed(spark):
    store = fresh(spark)
    q = frame(spark, [[0.0, 0.0]], "question_id")
    assert store.topk(q).count() == 0                        # never built
    assert store.build(frame(spark, [[1.0, 0.0], [2.0, 0.0]])) == 1
    spark.range(1).write.parquet(f"{store.path}/v=2/rows")   # no commit
    assert [r["id"] for r in store.topk(q, k=1).collect()] == [0]
    assert store.build(frame(spark, [[3.0, 0.0], [1.0, 0.0]])) == 2
    assert [r["id"] for r in store.topk(q, k=1).collect()] == [1]
    assert [r["id"] for r in store.topk(q, k=1, version=1).collect()] == [0]


def test_few_rows_repeated_rows_and_no_rows(spark):
    q = frame(spark, [[0.0, 0.0]], "question_id")
    store = fresh(spark)
    store.build(frame(spark, [[1.0, 1.0]] * 3))
    assert [(r["rank"], r["id"]) for r in store.topk(q, k=5).orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]
    store.build(frame(spark, [[1.0, 1.0]]).where(F.col("id") < 0))
    assert store.topk(q).count() == 0
    assert store.topk(q, version=1, k=1).count() == 1


def test_training_on_a_share_of_the_rows_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(list_store, "TRAIN_ROWS", 2)
    m = clustered(seed=5)
    corpus, questions = frame(spark, m), frame(spark, m[::60], "question_id")
    store = fresh(spark)
    store.build(corpus, n_lists=16)
    assert got(store.topk(questions, k=4)) == got(knn.topk(questions, corpus, k=4))
