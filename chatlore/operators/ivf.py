"""Top-k through inverted lists (F2): k-means lists with bounds that make the pruning exact.

* centroids: ``pyspark.ml`` KMeans over the whole corpus;
* one pass assigns every row to its nearest list and keeps the row's distance
  to the centroid; a list's radius is the largest of them;
* a question's k-th neighbour is no farther than ``reach``: the least distance
  within which whole lists (centroid distance plus radius) hold ``k`` rows.
  Only lists that begin within it (centroid distance minus radius) are read,
  so no neighbour is missed and every question gets ``min(k, N)`` rows;
* small lists are bundled and a list holding many rows is split by a salt, and
  the questions probing a bundle are cut into blocks, so each ``cogroup`` group
  holds at most about ``max_group_rows`` corpus rows and ``max_group_questions``
  questions, and no more of either than fit ``knn.GRID_BYTES``, whatever the skew; a question goes to a bundle once (``meet_lists``);
* each group keeps its local top-k per question (numpy), a
  ``row_number() <= k`` window keeps the global top-k.

Lists, radii and sizes are bounded by ``n_lists`` and are the only data
broadcast.  Cosine distance is the euclidean one of unit vectors; inner
products have no such bound and are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore.operators.knn import _CELLS, _as_matrix, _global_topk, _no_rows, _Questions, _scan_topk, _TopK, group_rows
from chatlore.session import materialize


SLACK = 1e-6  # of the bounds, for rounding


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose euclidean distance ranks like the metric."""
    if metric != "cosine":
        return m
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (q * q).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2.0 * q @ centroids.T
    return np.sqrt(np.maximum(d, 0.0))


def _lists_in_reach(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """(question, list) pairs that can hold one of the ``k`` nearest rows."""
    d = _distances(q, centroids)
    far = d + radius
    order = np.argsort(far, axis=1)
    held = np.cumsum(size[order], axis=1)
    last = np.minimum((held < k).sum(axis=1), len(size) - 1)
    reach = np.take_along_axis(np.take_along_axis(far, order, 1), last[:, None], 1)
    return np.argwhere((d - radius <= reach + SLACK * (1 + reach)) & (size > 0))


def _blocks(rows: int, lists: int) -> Iterator[slice]:
    """Row blocks whose distances to all lists are a bounded matrix."""
    step = max(1, _CELLS // max(1, lists))
    for start in range(0, rows, step):
        yield slice(start, start + step)


def nearest_list(m: np.ndarray, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest list and its distance to that centroid."""
    m = _unit(m, metric)
    near, away = np.empty(len(m), np.int32), np.empty(len(m))
    for b in _blocks(len(m), len(centroids)):
        d = _distances(m[b], centroids)
        near[b], away[b] = d.argmin(axis=1), d.min(axis=1)
    if metric == "cosine":  # a zero vector has no direction: as far as any unit vector can be
        away[(m * m).sum(axis=1) == 0] = 2.0
    return near, away


def lists_to_read(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int,
                  metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(question, list) pairs whose lists can hold one of the ``k`` nearest rows."""
    q = _unit(q, metric)
    parts = [_lists_in_reach(q[b], centroids, radius, size, k) + [b.start, 0] for b in _blocks(len(q), len(centroids))]
    if metric == "cosine":  # a zero vector is at distance 1 of all rows, and so is a zero row
        zero = np.flatnonzero((q * q).sum(axis=1) == 0)
        lists = np.flatnonzero(size > 0)
        parts.append(np.stack([np.repeat(zero, len(lists)), np.tile(lists, len(zero))], axis=1))
    who, near = np.unique(np.concatenate(parts), axis=0).T
    return who, near


def topk_ivf(questions: DataFrame, corpus: DataFrame, k: int = 5, metric: str = "l2sq",
             qid: str = "question_id", qvec: str = "embedding", id_col: str = "id", vec: str = "embedding",
             n_lists: int | None = None, max_group_rows: int = 100_000, max_group_questions: int = 20_000,
             seed: int = 42, max_iter: int = 10) -> DataFrame:
    if metric not in ("l2sq", "cosine"):
        raise ValueError("inverted lists need l2sq or cosine distances")
    spark = corpus.sparkSession
    csel = corpus.select(F.col(id_col), F.col(vec).alias("_cv")).where(F.col("_cv").isNotNull())
    qsel = questions.select(F.col(qid), F.col(qvec).alias("_qv")).where(F.col("_qv").isNotNull())
    n = csel.count()
    if n == 0:
        schema = T.StructType([T.StructField(qid, questions.schema[qid].dataType),
                               T.StructField(id_col, corpus.schema[id_col].dataType),
                               T.StructField("rank", T.IntegerType()), T.StructField("distance", T.DoubleType())])
        return spark.createDataFrame([], schema)
    lists = min(n, n_lists or max(1, int(math.sqrt(n))))
    points = array_to_vector("_cv")
    if metric == "cosine":
        from pyspark.ml.feature import Normalizer

        train = Normalizer(inputCol="_v", outputCol="_f").transform(csel.select(points.alias("_v"))).select("_f")
    else:
        train = csel.select(points.alias("_f"))
    model = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="_list").fit(train)
    centroids = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    lists, dim = centroids.shape
    bc = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not pdf.empty:
                near, away = nearest_list(_as_matrix(pdf["_cv"], dim), bc.value, metric)
                yield pdf.assign(_list=near, _away=away)

    assigned = materialize(csel.mapInPandas(assign, T.StructType(
        [*csel.schema.fields, T.StructField("_list", T.IntegerType()), T.StructField("_away", T.DoubleType())])))
    radius, size = np.zeros(lists), np.zeros(lists, np.int64)
    for r in assigned.groupBy("_list").agg(F.max("_away").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # n_lists rows
        radius[r["_list"]], size[r["_list"]] = r["r"], r["n"]
    cands = meet_lists(assigned.drop("_away"), qsel, qid, id_col, (np.arange(lists), centroids, radius, size), dim, metric, k,
                       max_group_rows, max_group_questions)
    return _global_topk(cands, qid, id_col, k).select(qid, id_col, "rank", "distance")


def bundles(size: np.ndarray, max_group_rows: int) -> np.ndarray:
    """Neighbouring lists in one bundle while their rows fit a group."""
    at, bundle, held = np.empty(len(size), np.int32), -1, max_group_rows
    for k, n in enumerate(size):
        if held + n > max_group_rows:
            bundle, held = bundle + 1, 0
        at[k], held = bundle, held + n
    return at


def meet_lists(rows: DataFrame, asked: DataFrame, qid: str, id_col: str,
               table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dim: int, metric: str, k: int,
               max_group_rows: int, max_group_questions: int) -> DataFrame:
    """Local top-k of the questions (``qid``, ``_qv``) over the rows (``id_col``, ``_cv``, ``_list``) of the lists that can
    hold a neighbour, in ``cogroup`` groups of bounded size.  ``table``: name, centroid, radius and rows of every list.

    Lists are bundled up to ``max_group_rows``, larger ones are split by a salt.  A question goes once to every bundle
    in which it has a list, however many lists that are, and picks its lists there.
    """
    spark = rows.sparkSession
    names, centroids, radius, size = table
    max_group_rows, max_group_questions = group_rows(max_group_rows, dim), group_rows(max_group_questions, dim)
    bundle = bundles(size, max_group_rows)
    shared = spark.sparkContext.broadcast((names, centroids, radius, size, bundle))
    qid_field, id_field = asked.schema[qid], rows.schema[id_col]

    def reach(vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Which lists each question reads, some questions at a time."""
        names, centroids, radius, size, _ = shared.value
        for b in _blocks(len(vectors), len(names)):
            needs = np.zeros((len(vectors[b]), len(names)), bool)
            needs[lists_to_read(vectors[b], centroids, radius, size, k, metric)] = True
            yield b, needs

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = shared.value[4]
        starts = np.flatnonzero(np.diff(bundle, prepend=-1))
        for pdf in batches:
            if not pdf.empty:
                for b, needs in reach(_as_matrix(pdf["_qv"], dim)):
                    who, group = np.nonzero(np.logical_or.reduceat(needs, starts, axis=1))
                    for s in range(0, len(who), 4096):
                        some = who[s:s + 4096]
                        yield pd.DataFrame({qid: pdf[qid].to_numpy()[b][some], "_qv": pdf["_qv"].to_numpy()[b][some],
                                            "_g": group[s:s + 4096].astype(np.int32)})

    sent = materialize(asked.select(qid, "_qv").mapInPandas(
        send, T.StructType([qid_field, asked.schema["_qv"], T.StructField("_g", T.IntegerType())])))
    asks = {r["_g"]: r["n"] for r in sent.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}   # a row a bundle
    held = np.bincount(bundle, weights=size)
    plan = spark.createDataFrame([(int(g), max(1, math.ceil(held[g] / max_group_rows)), max(1, math.ceil(n / max_group_questions)))
                                  for g, n in asks.items()], "_g int, _s int, _b int")
    place = spark.createDataFrame(list(zip(names.tolist(), bundle.tolist())), "_list int, _g int")
    plan, place = F.broadcast(plan), F.broadcast(place)     # at most a row a list
    corpus_g = (rows.select(id_col, "_cv", "_list").join(place, "_list").join(plan, "_g")
                .withColumn("_salt", F.pmod(F.xxhash64(id_col, "_cv"), F.col("_s")).cast("int"))
                .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_s", "_b"))
    ques_g = (sent.join(plan, "_g").withColumn("_blk", F.pmod(F.xxhash64(qid, "_qv"), F.col("_b")).cast("int"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s", "_b"))

    def pair(corp: pd.DataFrame, ques: pd.DataFrame) -> pd.DataFrame:
        if corp.empty or ques.empty:
            return _no_rows(qid, id_col)
        here, ids, vectors = corp["_list"].to_numpy(), corp[id_col].to_numpy(), _as_matrix(corp["_cv"], dim)
        q = _Questions(ques[qid].to_numpy(), _as_matrix(ques["_qv"], dim), metric)
        mine = np.flatnonzero(np.isin(shared.value[0], here))
        needs = np.concatenate([n[:, mine] for _, n in reach(q.mat)])
        nearest = _TopK(q, k)
        for j, name in enumerate(shared.value[0][mine]):
            if needs[:, j].any():
                of = here == name
                nearest.add(ids[of], vectors[of], needs[:, j])
        res = nearest.result()
        return pd.DataFrame({qid: q.ids[res["_qi"].to_numpy(dtype=np.int64)], id_col: res["id"].to_numpy(),
                             "distance": res["distance"].to_numpy()})

    out = T.StructType([qid_field, id_field, T.StructField("distance", T.DoubleType())])
    return (corpus_g.groupBy("_g", "_salt", "_blk")
            .cogroup(ques_g.groupBy("_g", "_salt", "_blk")).applyInPandas(pair, out))


def meet(assigned: DataFrame, probes: DataFrame, qid: str, id_col: str, qid_field: T.StructField, id_field: T.StructField,
         dim: int, metric: str, k: int, max_group_rows: int, max_group_questions: int) -> DataFrame:
    """Local top-k of the questions that probe a list (``_list``, ``_qv``) over its rows (``_list``, ``_cv``),
    in ``cogroup`` groups of bounded size."""
    max_group_rows, max_group_questions = group_rows(max_group_rows, dim), group_rows(max_group_questions, dim)
    # per-list fan-out: salts for big lists, question blocks for popular lists
    csize = assigned.groupBy("_list").agg(F.count("*").alias("_nc"))
    qsize = probes.groupBy("_list").agg(F.count("*").alias("_nq"))
    plan = (csize.join(qsize, "_list", "full_outer")
            .select("_list",
                    F.greatest(F.lit(1), F.ceil(F.coalesce("_nc", F.lit(0)) / max_group_rows)).cast("int").alias("_s"),
                    F.greatest(F.lit(1), F.ceil(F.coalesce("_nq", F.lit(0)) / max_group_questions)).cast("int")
                    .alias("_b")))
    plan = F.broadcast(plan)  # at most n_lists rows

    corpus_g = (assigned.join(plan, "_list")
                .withColumn("_salt", F.pmod(F.xxhash64(id_col, "_cv"), F.col("_s")).cast("int"))
                .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
                .drop("_s", "_b"))
    ques_g = (probes.join(plan, "_list")
              .withColumn("_blk", F.pmod(F.xxhash64(qid, "_qv"), F.col("_b")).cast("int"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
              .drop("_s", "_b"))

    out = T.StructType([qid_field, id_field, T.StructField("distance", T.DoubleType())])

    def pair(corp: pd.DataFrame, ques: pd.DataFrame) -> pd.DataFrame:
        if corp.empty or ques.empty:
            return _no_rows(qid, id_col)
        q = _Questions(ques[qid].to_numpy(), _as_matrix(ques["_qv"], dim), metric)
        res = _scan_topk(q, iter([(corp[id_col].to_numpy(), _as_matrix(corp["_cv"], dim))]), k)
        return pd.DataFrame({qid: q.ids[res["_qi"].to_numpy(dtype=np.int64)],
                             id_col: res["id"].to_numpy(), "distance": res["distance"].to_numpy()})

    return (corpus_g.groupBy("_list", "_salt", "_blk")
            .cogroup(ques_g.groupBy("_list", "_salt", "_blk"))
            .applyInPandas(pair, out))


def recall_at_k(approx: DataFrame, exact: DataFrame, qid: str = "question_id", id_col: str = "id") -> float:
    """Share of exact top-k (question, id) pairs the approximate search found."""
    hit = exact.join(approx.select(qid, id_col), [qid, id_col], "left_semi").count()
    total = exact.count()
    return hit / total if total else 1.0
