"""Vector index upsert properties and top-k search semantics."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlore.operators import ivf, knn
from chatlore.session import scratch_path
from chatlore.sources import views
from chatlore.sources.vector_index import VectorIndex
from conftest import SF_MID


def docs(spark, rows):
    """rows: (id, text, ts, vec)"""
    data = [(i, t, {"author": "A", "slack_url": None, "channel_id": "C", "timestamp": ts}, v)
            for i, t, ts, v in rows]
    return spark.createDataFrame(
        data, "id string, text string, metadata struct<author:string,slack_url:string,channel_id:string,"
              "timestamp:string>, embedding array<float>")


def fresh(spark):
    return VectorIndex(spark, scratch_path(spark, f"test-index-{uuid.uuid4().hex}"))


def test_missing_index_is_empty(spark):
    idx = fresh(spark)
    assert idx.current_version() is None and idx.count() == 0


def test_upsert_insert_replace_never_delete(spark):
    idx = fresh(spark)
    assert idx.upsert(docs(spark, [("a", "1", "1.0", [1.0]), ("b", "2", "1.0", [2.0])])) == 1
    assert idx.upsert(docs(spark, [("b", "2v2", "2.0", [3.0]), ("c", "3", "1.0", [4.0])])) == 2
    rows = {r.id: (r.text, list(r.embedding)) for r in idx.read().collect()}
    assert rows == {"a": ("1", [1.0]), "b": ("2v2", [3.0]), "c": ("3", [4.0])}
    assert idx.read(1).count() == 2  # the older snapshot is untouched


def test_upsert_idempotent_and_empty_batch(spark):
    idx = fresh(spark)
    batch = docs(spark, [("a", "1", "1.0", [1.0]), ("b", "2", "1.0", [2.0])])
    idx.upsert(batch)
    idx.upsert(batch)
    assert idx.count() == 2
    assert idx.upsert(batch.limit(0)) is None
    assert idx.versions() == [1, 2]


def test_duplicate_ids_in_one_batch_keep_newest(spark):
    idx = fresh(spark)
    idx.upsert(docs(spark, [("a", "old", "1.0", [1.0]), ("a", "new", "2.0", [2.0]), ("a", "mid", "1.5", [3.0])]))
    assert [r.text for r in idx.read().collect()] == ["new"]


def vec_frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_fewer_rows_than_k(spark):
    corpus = vec_frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])])
    q = vec_frame(spark, [(7, [0.0, 0.0])], "question_id")
    hits = knn.topk(q, corpus, k=5).orderBy("rank").collect()
    assert [(h.id, h.rank, h.distance) for h in hits] == [(1, 1, 0.0), (2, 2, 1.0), (3, 3, 4.0)]
    empty = corpus.limit(0)
    assert knn.topk(q, empty, k=5).count() == 0


def test_ties_break_on_id(spark):
    corpus = vec_frame(spark, [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20, 0, -1)])
    q = vec_frame(spark, [(1, [0.0, 0.0])], "question_id")
    hits = knn.topk(q, corpus, k=4).orderBy("rank").collect()
    assert [h.id for h in hits] == [1, 2, 3, 4]


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_exact_against_brute_force(spark, metric):
    rng = np.random.default_rng(0)
    c = rng.normal(size=(300, 8)).astype(np.float32)
    q = rng.normal(size=(25, 8)).astype(np.float32)
    corpus = vec_frame(spark, [(i, c[i].tolist()) for i in range(len(c))])
    ques = vec_frame(spark, [(i, q[i].tolist()) for i in range(len(q))], "question_id")
    got = {(r.question_id, r.rank): r.id for r in knn.topk(ques, corpus, k=5, metric=metric).collect()}
    qq, cc = q.astype(np.float64), c.astype(np.float64)
    for i in range(len(q)):
        if metric == "l2sq":
            d = ((cc - qq[i]) ** 2).sum(1)
        elif metric == "cosine":
            d = 1 - cc @ qq[i] / (np.linalg.norm(cc, axis=1) * np.linalg.norm(qq[i]))
        else:
            d = 1 - cc @ qq[i]
        order = np.lexsort((np.arange(len(d)), d))[:5]
        assert [got[(i, r + 1)] for r in range(5)] == order.tolist()


def test_grid_path_equals_broadcast_path(spark):
    vecs = views.vectors(spark, SF_MID)
    q = vecs.withColumnRenamed("id", "question_id")
    a = knn.topk(q, vecs, k=5)
    b = knn.topk(q, vecs, k=5, max_broadcast_bytes=10_000, corpus_blocks=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_topk_plan_has_group_limit_and_no_pair_join(spark):
    vecs = views.vectors(spark, SF_MID)
    hits = knn.topk(vecs.withColumnRenamed("id", "question_id"), vecs, k=5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ivf_recall_and_hot_list_split(spark):
    vecs = views.vectors(spark, SF_MID)
    q = vecs.withColumnRenamed("id", "question_id")
    exact = knn.topk(q, vecs, k=5).cache()
    listed = ivf.topk_ivf(q, vecs, k=5, n_lists=8)
    assert ivf.recall_at_k(listed, exact) == 1.0
    # tiny group bounds force salting of every list and blocking of questions
    salted = ivf.topk_ivf(q, vecs, k=5, n_lists=8, max_group_rows=20, max_group_questions=30)
    assert salted.exceptAll(listed).count() == 0


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_ivf_is_exact_on_uneven_clusters(spark, metric):
    """Clusters of very different sizes and norms, one of two rows, zero vectors: same rows as the scan."""
    rng = np.random.default_rng(5)
    rows = [c * np.ones(4) + rng.normal(0, s, 4) for c, s, n in ((0, 1, 200), (30, .1, 2), (-9, 3, 60)) for _ in range(n)]
    rows += [np.zeros(4)] * 3
    corpus = vec_frame(spark, [(i, r.tolist()) for i, r in enumerate(rows)])
    ques = vec_frame(spark, [(i, r.tolist()) for i, r in enumerate(rows) if i % 9 == 0 or i in (200, 201, 264)], "question_id")
    exact = {(r.question_id, r["rank"]): round(r.distance, 9) for r in knn.topk(ques, corpus, k=5, metric=metric).collect()}
    listed = {(r.question_id, r["rank"]): round(r.distance, 9) for r in ivf.topk_ivf(ques, corpus, k=5, metric=metric, n_lists=12).collect()}
    assert listed == exact and len(exact) == 5 * ques.count()
    with pytest.raises(ValueError):
        ivf.topk_ivf(ques, corpus, metric="ip")


def test_ties_keep_k_rows_in_a_task():
    import pandas as pd

    q = knn._Questions(np.arange(10), np.ones((10, 4)), "l2sq")
    x = np.ones((100_000, 4))
    got = knn._scan_topk(q, iter([(np.arange(100_000), x), (np.arange(100_000, 200_000), x)]), 5)
    assert len(got) == 50 and sorted(set(got["id"])) == [0, 1, 2, 3, 4] and isinstance(got, pd.DataFrame)


def test_payload_columns_do_not_depend_on_the_path(spark):
    hits = spark.createDataFrame([(1, 1, 7, 0.5)], "q long, rank int, id long, distance double")
    index = spark.createDataFrame([(7, "t", [1.0])], "id long, text string, embedding array<double>")
    a, b = (knn.with_payload(hits, index, payload=("text",), max_rows=n) for n in (1, None))
    assert a.columns == b.columns == ["q", "rank", "id", "distance", "text"] and a.collect() == b.collect()


def test_crashed_write_does_not_block_the_index(spark):
    import os
    import uuid

    from chatlore.session import scratch_path
    from chatlore.sources.vector_index import VectorIndex

    index = VectorIndex(spark, scratch_path(spark, f"crash-{uuid.uuid4().hex}"))
    docs = spark.createDataFrame([("a", "t", None, [1.0])], "id string, text string, metadata struct<author:string,slack_url:string,"
                                 "channel_id:string,timestamp:string>, embedding array<float>")
    assert index.upsert(docs) == 1
    os.makedirs(index.path.replace("file:", "") + "/v=2")
    assert index.upsert(docs) == 3 and index.versions() == [1, 3] and index.count() == 1
    hit = index.search(spark.createDataFrame([(1, [1.0])], "question_id long, embedding array<float>")).first()
    assert (hit.id, hit.text, hit.distance) == ("a", "t", 0.0)


def test_search_observation(spark):
    from pyspark.sql import Observation

    from chatlore.config import Params
    from chatlore.operators import embed as E
    from chatlore.plans import retrieve as R
    from conftest import SF_SMALL

    docs = views.table(spark, SF_SMALL, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text",
        F.struct(F.lit("A").alias("author"), F.lit("u").alias("slack_url")).alias("metadata"))
    index = E.embed(docs, "text").drop("embed_status", "embed_error")
    obs = Observation("retrieval")
    out = R.search(views.questions(spark, SF_SMALL), index, Params(top_k=3), observation=obs)
    n = out.count()
    assert obs.get["returned"] == n == 3 * views.questions(spark, SF_SMALL).count()
    assert obs.get["top_k_seen"] == 3 and obs.get["context_chars"] > 0


def test_search_switch_to_ivf(spark):
    from chatlore.config import Params
    from chatlore.operators import embed as E
    from chatlore.plans import retrieve as R
    from conftest import SF_SMALL

    docs = views.table(spark, SF_SMALL, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text",
        F.struct(F.lit("A").alias("author"), F.lit("u").alias("slack_url")).alias("metadata"))
    index = E.embed(docs, "text").drop("embed_status", "embed_error").cache()
    qs = views.questions(spark, SF_SMALL)
    exact = R.search(qs, index, Params(), payload=False)
    approx = R.search(qs, index, Params(search="ivf", ivf_lists=4), payload=False)
    assert approx.exceptAll(exact).count() == 0 and exact.exceptAll(approx).count() == 0


@pytest.mark.parametrize("seed,n,k", [(1, 1, 5), (2, 4, 5), (3, 30, 5), (4, 30, 1)])
def test_topk_properties(spark, seed, n, k):
    rng = np.random.default_rng(seed)
    corpus = vec_frame(spark, [(i, rng.integers(0, 3, size=4).astype(float).tolist()) for i in range(n)])
    ques = vec_frame(spark, [(i, rng.integers(0, 3, size=4).astype(float).tolist()) for i in range(6)],
                     "question_id")
    rows = knn.topk(ques, corpus, k=k).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.question_id, []).append(r)
    assert set(by_q) == set(range(6))
    for hits in by_q.values():
        hits.sort(key=lambda r: r.rank)
        assert [h.rank for h in hits] == list(range(1, min(k, n) + 1))
        assert all(a.distance <= b.distance for a, b in zip(hits, hits[1:]))
        assert all(a.id < b.id for a, b in zip(hits, hits[1:]) if a.distance == b.distance)


def placed_docs(spark, rows):
    """rows: (id, text, channel, ts); the id None is the loader's digest."""
    from chatlore.functions.text import doc_id

    df = spark.createDataFrame([(i, t, {"author": "A", "slack_url": None, "channel_id": c, "timestamp": ts}, [1.0]) for i, t, c, ts in rows],
                               "id string, text string, metadata struct<author:string,slack_url:string,channel_id:string,"
                               "timestamp:string>, embedding array<float>")
    return df.withColumn("id", F.coalesce("id", doc_id("metadata.channel_id", "metadata.timestamp")))


def index_files(index):
    root = index.path.replace("file:", "") + "/data"
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


DAY = 86_400


def test_small_upsert_leaves_other_partitions_alone(spark):
    index = fresh(spark)
    index.upsert(placed_docs(spark, [(None, f"{c}{d}{k}", c, f"{DAY * d + k}.5") for c in ("C1", "C2") for d in range(4) for k in range(3)]))
    before = index_files(index)
    assert len({os.path.dirname(f) for f in before}) == 8
    assert index.upsert(placed_docs(spark, [(None, "new", "C2", f"{DAY * 2 + 1}.5"), (None, "more", "C2", f"{DAY * 2 + 9}.5")])) == 2
    after = index_files(index)
    assert {f: after[f] for f in before} == before                      # nothing rewritten in place
    assert {os.path.dirname(f) for f in after.keys() - before.keys()} == {"w=2/p_channel=c-C2/p_day=2"}
    assert index.count() == 25 and index.read(1).count() == 24
    rows = {(r.metadata.channel_id, r.metadata.timestamp): r.text for r in index.read().collect()}
    assert rows["C2", f"{DAY * 2 + 1}.5"] == "new" and rows["C1", f"{DAY * 2 + 1}.5"] == "C121"
    opened = index.read().inputFiles()                                  # the superseded partition is not opened
    assert not any("w=1/p_channel=c-C2/p_day=2" in f for f in opened) and len({os.path.dirname(f) for f in opened}) == 8


def test_old_versions_can_be_dropped(spark):
    index = fresh(spark)
    for text in ("a", "b", "c"):
        index.upsert(placed_docs(spark, [(None, text, "C1", "5.0")]))
    index.upsert(placed_docs(spark, [(None, "other", "C2", "5.0"), (None, "third", "C2", f"{DAY}.0")]))
    index.upsert(placed_docs(spark, [(None, "other 2", "C2", "5.0")]))
    os.makedirs(index.path.replace("file:", "") + "/data/w=9/p_channel=c-x")   # a failed upsert
    assert index.drop_versions(keep=2) == [1, 2, 3] and index.versions() == [4, 5]
    assert {os.path.dirname(f) for f in index_files(index)} == {"w=3/p_channel=c-C1/p_day=0", "w=4/p_channel=c-C2/p_day=0",
                                                               "w=4/p_channel=c-C2/p_day=1", "w=5/p_channel=c-C2/p_day=0"}
    assert sorted(r.text for r in index.read(4).collect()) == ["c", "other", "third"]
    assert index.drop_versions() == [4] and sorted(r.text for r in index.read().collect()) == ["c", "other 2", "third"]
    assert {os.path.dirname(f) for f in index_files(index)} == {"w=3/p_channel=c-C1/p_day=0", "w=4/p_channel=c-C2/p_day=1",
                                                               "w=5/p_channel=c-C2/p_day=0"}
    assert index.upsert(placed_docs(spark, [(None, "d", "C1", "5.0")])) == 6 and index.count() == 3


def test_ids_may_move_between_partitions(spark):
    """Ids that are no digest of their place are looked for everywhere; null and odd channels are places too."""
    index = fresh(spark)
    index.upsert(placed_docs(spark, [("x", "1", "C1", "5.0"), ("y", "2", None, None), ("z", "3", "odd/ channel*", "bad"), (None, "4", "C1", "7.0")]))
    assert {r.p_channel[:2] for r in index.manifest().collect()} == {"c-", "no", "h-"}
    index.upsert(placed_docs(spark, [("x", "1b", "C2", f"{DAY * 3}.0"), ("z", "3b", None, "1.0")]))
    assert {r.id if len(r.id) == 1 else "digest": r.text for r in index.read().collect()} == {"x": "1b", "y": "2", "z": "3b", "digest": "4"}
    flags = {(r.p_channel, r.p_day): r.by_place for r in index.manifest().collect()}
    assert flags["c-C1", "0"] and not flags["c-C2", "3"]


def test_many_folders_are_read_by_a_join(spark, monkeypatch):
    from chatlore.sources import vector_index

    index = fresh(spark)
    for k in range(3):
        index.upsert(placed_docs(spark, [(None, f"{k}{d}", "C1", f"{DAY * d}.0") for d in range(k, 5)]))
    want = sorted(r.text for r in index.read().collect())
    monkeypatch.setattr(vector_index, "MAX_FOLDERS", 2)
    assert sorted(r.text for r in index.read().collect()) == want == ["00", "11", "22", "23", "24"]
    index.upsert(placed_docs(spark, [(None, "new", "C1", f"{DAY * 2}.0"), ("moved", "m", "C9", "1.0")]))
    assert sorted(r.text for r in index.read().collect()) == ["00", "11", "23", "24", "m", "new"]


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_a_scan_holds_bounded_matrices(monkeypatch, metric):
    """Many questions and equal rows: exact distances and approximate ones come in steps, rows are those of brute force."""
    rng = np.random.default_rng(8)
    m, x = np.round(rng.normal(size=(5_000, 6)), 1), np.round(rng.normal(size=(3_000, 6)), 1)
    x[100:1_500] = x[100]
    exact, approx, pairs, cells = knn._exact, knn._approx, [], []
    monkeypatch.setattr(knn, "_exact", lambda a, b, how: pairs.append(len(a)) or exact(a, b, how))
    monkeypatch.setattr(knn, "_approx", lambda q, rows: cells.append(len(q.ids) * len(rows)) or approx(q, rows))
    got = knn._scan_topk(knn._Questions(np.arange(len(m)), m, metric), iter([(np.arange(len(x)), x)]), 5)
    assert max(pairs) <= 1 << 14 and max(cells) <= 1 << 20
    for i in range(0, len(m), 499):
        d = exact(np.repeat(m[i:i + 1], len(x), 0), x, metric)
        assert got[got["_qi"] == i]["id"].tolist() == np.lexsort((np.arange(len(x)), d))[:5].tolist()
