"""What tasks hold and what is moved stays bounded: embedder slices, kept tables, history lists, contexts."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chatlore.config import Params
from chatlore.operators import embed as E
from chatlore.operators import history as H
from chatlore.operators import ivf, knn
from chatlore.operators.answer import Messages, given, on_requests
from chatlore.session import materialize


def test_embedder_gets_some_rows_at_once_and_a_bounded_memo(spark):
    df = spark.range(0, 2_000, 1, 1).select("id", F.lit("a b").alias("text"))
    out = E.embed(df, "text", lambda: lambda texts: [np.full(1, len(texts))] * len(texts), dim=1)
    assert out.agg(F.max(F.col("embedding")[0])).first()[0] <= E.SLICE_ROWS and out.count() == 2_000
    embedder = E.HashEmbedder(8)
    embedder(pd.Series([" ".join(f"t{i}" for i in range(E.MEMO_TOKENS + 5))]))
    assert len(embedder._memo) <= E.MEMO_TOKENS


def test_sql_embedder_counts_in_one_pass(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, None), (3, "..."), (4, "é ß 7")], "id long, text string")
    out = E.hash_embed_sql(df, "id", dim=64)
    assert "array_position" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = E.HashEmbedder(64)
    got = {r.id: r.embedding for r in out.collect()}
    assert all(got[i] == want([t])[0].tolist() for i, t in ((1, "b a a"), (3, "..."), (4, "é ß 7")))
    assert got[2] == [0.0] * 64


def test_a_kept_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    kept = materialize(spark.range(100).mapInPandas(count, "id long"))
    assert kept.count() == 100 and seen.value == 100


def test_history_lists_are_not_aggregated_per_turn(spark):
    turns = spark.createDataFrame([(i, "s", f"{i}.0", f"q{i}", f"a{i}", "ok") for i in range(40)],
                                  "event_id long, session_key string, ts string, query string, answer string, status string")
    got = H.history_messages(turns, F.col("status") == "ok")
    assert "_row" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.event_id: len(r.history) for r in got.collect()} == {i: 2 * i for i in range(40)}


def test_a_view_of_the_messages_is_no_copy_and_does_not_grow():
    history = [{"role": "user", "content": "a"}]

    class Asks:
        takes_view = True

        def __call__(self, request):
            return request["messages"]

    ask = on_requests(Asks, Params())()
    seen = ask(given(history, ask), "now")
    history.append({"role": "assistant", "content": "b"})
    assert isinstance(seen, Messages) and seen.grown.grown is history
    assert [m["content"] for m in seen] == ["a", "now"] and seen[-1]["content"] == "now" and seen[0:1] == history[:1]
    plain = on_requests(lambda: lambda request: request["messages"], Params())()
    assert plain(given(history, plain), "now") == [*history, {"role": "user", "content": "now"}]


def test_small_lists_share_a_bundle():
    assert ivf.bundles(np.array([3, 3, 5, 20, 0, 4]), 8).tolist() == [0, 0, 1, 2, 3, 3]


def test_a_question_goes_to_a_bundle_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ivf, "materialize", lambda df: kept.append(materialize(df)) or kept[-1])
    vecs = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, embedding array<double>")
    found = ivf.topk_ivf(vecs.withColumnRenamed("id", "question_id"), vecs, k=50, n_lists=8)
    assert found.count() == 60 * 50 and kept[-1].count() == 60


def test_questions_are_held_as_they_came_and_blocks_let_go(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1 << 15, 64)).astype(np.float32)
    tracemalloc.start()
    q = knn._Questions(np.arange(len(m)), m, "l2sq")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert q.mat.dtype == np.float32 and peak < m.nbytes / 2         # no second copy of the matrix
    some, rows = q.some(slice(0, 3_000)), m[:500]
    nearest = knn._TopK(some, 5)
    nearest.add(np.arange(500), rows)
    found = pd.concat([r for k, r in enumerate(nearest.results()) if nearest.blocks[k] is None], ignore_index=True)
    wide = knn._Questions(some.ids, some.mat.astype(np.float64), "l2sq")
    assert found.equals(knn._scan_topk(wide, iter([(np.arange(500), rows.astype(np.float64))]), 5))

    kept, as_matrix = [], knn._as_matrix
    monkeypatch.setattr(knn, "_as_matrix", lambda *a: kept.append(as_matrix(*a)) or kept[-1])
    vecs = spark.createDataFrame([(i, [float(i % 7), i / 3]) for i in range(60)], "id long, embedding array<float>")
    assert knn.topk(vecs.withColumnRenamed("id", "question_id"), vecs).count() == 300
    assert [k.dtype for k in kept] == [np.float32]                   # what is broadcast


def test_groups_are_bounded_in_bytes_also_with_one_id(spark, monkeypatch):
    def sizes(q, batches, k):
        (ids, x), = batches
        return pd.DataFrame({"_qi": [0], "id": ids[:1], "distance": [float(max(len(ids), len(q.ids)))]})

    monkeypatch.setattr(ivf, "_scan_topk", sizes)
    monkeypatch.setattr(knn, "_scan_topk", sizes)
    monkeypatch.setattr(knn, "GRID_BYTES", 50 * 2 * 8)               # 50 rows of two doubles
    data = [(7, [float(i), float(i % 9)], 3) for i in range(200)]
    rows = spark.createDataFrame(data, "id long, _cv array<double>, _list int")
    asked = spark.createDataFrame(data, "q long, _qv array<double>, _list int")
    met = ivf.meet(rows, asked, "q", "id", asked.schema["q"], rows.schema["id"], 2, "l2sq", 5, 100_000, 20_000)
    assert met.agg(F.max("distance")).first()[0] < 100 and met.count() == 16
    grid = knn.topk(asked, rows, 5, qid="q", qvec="_qv", vec="_cv", max_broadcast_bytes=50 * 2 * 8)
    assert grid.agg(F.max("distance")).first()[0] < 100
