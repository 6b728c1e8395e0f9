"""Retrieval for a whole table of questions.

Retrieval depends on the question text only, so identical texts are
embedded and searched once: the distinct step is a partial aggregate, which
also collapses a question repeated by a third of all events map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.config import Params
from chatlore.operators import embed as E
from chatlore.operators import knn
from chatlore.session import materialize


def question_key(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def distinct_questions(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """``(qkey, text)`` once per distinct text."""
    return (questions.select(question_key(F.col(text_col)).alias("qkey"), F.col(text_col).alias("text"))
            .groupBy("qkey").agg(F.min("text").alias("text")))


def search(questions: DataFrame, index: DataFrame, params: Params = Params(), embedder=None,
           text_col: str = "text", qid: str = "question_id", payload: bool = True,
           observation=None) -> DataFrame:
    """``(qid, rank, id, distance[, text, metadata])`` for every question.

    Ranking reads only ``(id, embedding)`` of the index; text and metadata
    are fetched for the winning ids only (late materialisation).  Questions
    with an empty index get no row (the caller's left join keeps them).
    """
    uniq = distinct_questions(questions, text_col)
    vecs = E.embed(uniq, "text", embedder, params.dim, fail_fast=True, model=params.model)
    vecs = materialize(vecs.select("qkey", "embedding"))  # read by the search and the bound
    hits = knn.search_topk(vecs, index.select("id", "embedding"), params.top_k, params.metric, "qkey",
                           params.search, params.ivf_lists, checkpoint_questions=False)
    if payload:
        hits = knn.with_payload(hits, index, max_rows=vecs.count() * params.top_k)
    keys = questions.select(F.col(qid), question_key(F.col(text_col)).alias("qkey"))
    out = keys.join(hits, "qkey", "inner").drop("qkey")
    cols = [qid, "rank", "id", "distance"] + (["text", "metadata"] if payload else [])
    out = out.select(*cols)
    if observation is not None:  # run counters, filled as the result is consumed
        counters = [F.count(F.lit(1)).alias("returned"), F.max("rank").alias("top_k_seen"),
                    F.max("distance").alias("max_distance")]
        if payload:
            counters.append(F.sum(F.length("text")).alias("context_chars"))
        out = out.observe(observation, *counters)
    return out
