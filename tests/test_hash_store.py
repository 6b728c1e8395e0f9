"""Hash buckets as a second store: recall against the exact search, whole results, versions."""

from __future__ import annotations

import uuid

import numpy as np
import pytest

from chatlore.operators import knn
from chatlore.operators.ivf import recall_at_k
from chatlore.session import scratch_path
from chatlore.sources import hash_store, views
from chatlore.sources.hash_store import HashStore, bucket_length, chance
from conftest import SF_MID
from test_list_store import clustered, frame, got


def fresh(spark, **options):
    return HashStore(spark, scratch_path(spark, f"hashes-{uuid.uuid4().hex}"), **options)


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_recall_on_clusters_with_few_groups_rows(spark, metric):
    m = clustered()
    m[5], m[20:30] = 0, m[20]                     # no direction; ties
    corpus, questions = frame(spark, [*m, None]), frame(spark, [*m[::9], np.zeros(8), None], "question_id")
    store = fresh(spark, metric=metric)
    store.build(corpus)
    found = store.topk(questions, k=5, max_group_rows=40, max_group_questions=7)
    exact = knn.topk(questions, corpus, k=5, metric=metric)
    assert found.count() == exact.count() and recall_at_k(found, exact) >= 0.9
    assert found.groupBy("question_id", "id").count().where("count > 1").count() == 0
    true = {(r["question_id"], r["id"]): r["distance"] for r in knn.topk(questions, corpus, k=len(m), metric=metric).collect()}
    assert all(abs(true[r["question_id"], r["id"]] - r["distance"]) < 1e-6 for r in found.collect())


def test_recall_on_the_embeddings(spark):
    vecs = views.vectors(spark, SF_MID)
    store = fresh(spark)
    store.build(vecs)
    questions = vecs.withColumnRenamed("id", "question_id")
    assert recall_at_k(store.topk(questions), knn.topk(questions, vecs)) >= 0.9


def test_buckets_prune_rows_far_away(spark, monkeypatch):
    m = clustered(clusters=30)
    store = fresh(spark)
    store.build(frame(spark, m))
    read = []
    meet = hash_store.meet
    monkeypatch.setattr(hash_store, "meet", lambda rows, *a: read.append(rows.select("id").distinct().count()) or meet(rows, *a))
    assert store.topk(frame(spark, m[700:701], "question_id"), k=3).count() == 3
    assert read[0] < len(m) / 2


def test_few_rows_far_questions_and_versions(spark):
    store = fresh(spark)
    q = frame(spark, [[0.0, 0.0], [1e6, 1e6]], "question_id")
    assert store.topk(q).count() == 0                                    # never built
    assert store.build(frame(spark, [[1.0, 1.0]] * 3)) == 1
    assert got(store.topk(q, k=5)) == got(knn.topk(q, frame(spark, [[1.0, 1.0]] * 3), k=5))
    assert store.last_search.questions == 2 and store.last_search.exact >= 1
    spark.range(1).write.parquet(f"{store.path}/v=2/rows")               # no commit
    assert store.versions() == [1]
    assert store.build(frame(spark, [None])) == 2 and store.topk(q).count() == 0
    assert store.topk(q, k=1, version=1).count() == 2
    with pytest.raises(ValueError):
        store.build(frame(spark, [[1.0], [1.0, 2.0]]))


def test_the_bucket_length_has_the_chance(spark):
    rng = np.random.default_rng(1)
    for tables, width in ((4, 2), (1, 1), (6, 3)):
        c = bucket_length(tables, width)
        at, off = rng.random((20_000, tables, width)), rng.normal(size=(20_000, tables, width))
        met = (np.abs(np.floor(at + off / c)) <= 1).all(axis=2).any(axis=1).mean()
        assert abs(met - chance(c, tables, width)) < 0.01 and met >= hash_store.TARGET - 0.01
