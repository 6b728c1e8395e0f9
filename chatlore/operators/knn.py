"""Top-k nearest neighbours.

Exact search never materialises question x corpus pairs.  Each task scans
its slice of the corpus once, computes distances to the questions with
matrix algebra in numpy, and emits only its local top-k per question; a
``row_number() <= k`` window (WindowGroupLimit) then keeps the global top-k.
The shuffle carries at most ``k x questions`` rows per task (plus exact ties).

* questions of checked size (``n x dim x 8 <= max_broadcast_bytes``) are a
  broadcast variable;
* beyond that, questions and corpus are cut into blocks and met in a
  ``cogroup`` on ``(question block, corpus block)``: every group is bounded,
  the corpus is read once per question block, nothing goes through the driver.

Distances are exact doubles: a fast expanded form (``|q|^2 + |x|^2 - 2 q.x``)
picks candidates with a rounding margin, and the candidates' distances are
recomputed directly.  Ties break on the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore.functions.vectors import METRICS
from chatlore.session import materialize

DEFAULT_BROADCAST_BYTES = 64 << 20
HIT_BYTES = 256  # of a hit: two ids of 64 characters, rank, distance, row overhead
GRID_BYTES = 32 << 20  # of one side of a group of the grid
_CELLS = 1 << 20  # distance-matrix cells per numpy step (8 MiB of doubles)
_STEP = 1 << 10  # questions per numpy step
_PAIRS = 1 << 14  # exact distances per numpy step, fewer if their vectors have more than _CELLS elements
_TOL = 1e-9


def _element(vectors: T.ArrayType) -> type:
    """The type that holds the elements of a column of vectors without loss."""
    return np.float32 if isinstance(vectors.elementType, T.FloatType) else np.float64


def group_rows(rows: int, dim: int) -> int:
    """Rows of a side of a group: at most so many, and no more than fit ``GRID_BYTES``."""
    return max(1, min(rows, GRID_BYTES // (8 * max(1, dim))))


def _as_matrix(col: pd.Series, dim: int, dtype: type = np.float64) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, dim), dtype=dtype)
    m = np.empty((len(col), dim), dtype=dtype)
    for s in range(0, len(col), 4096):  # no second copy of the whole
        part = np.stack([np.asarray(v, dtype=dtype) for v in col.values[s:s + 4096]])
        if part.shape[1] != dim:
            raise ValueError(f"vector dimension {part.shape[1]} != {dim}")
        m[s:s + 4096] = part
    return m


class _Questions:
    """Question matrix with the per-metric precomputations.  It is held as it came; ``wide`` is it in doubles."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, metric: str):
        self.ids = ids
        self.mat = mat
        self.metric = metric
        self.sq = np.empty(len(mat))
        for s in range(0, len(mat), _STEP):
            part = mat[s:s + _STEP].astype(np.float64, copy=False)
            self.sq[s:s + _STEP] = (part * part).sum(axis=1)
        self.norm = np.sqrt(self.sq)

    @property
    def unit(self) -> np.ndarray:
        return self.mat / np.where(self.norm == 0, 1.0, self.norm)[:, None]

    def some(self, which) -> _Questions:
        part = object.__new__(_Questions)
        part.metric = self.metric
        part.ids, part.mat, part.sq, part.norm = self.ids[which], self.mat[which], self.sq[which], self.norm[which]
        return part

    def wide(self) -> _Questions:
        if self.mat.dtype == np.float64:
            return self
        part = self.some(slice(None))
        part.mat = self.mat.astype(np.float64)
        return part


def _exact(qm: np.ndarray, xm: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise exact distances of aligned pairs."""
    if metric == "l2sq":
        d = qm - xm
        return (d * d).sum(axis=1)
    dots = (qm * xm).sum(axis=1)
    if metric == "ip":
        return 1.0 - dots
    nq = np.sqrt((qm * qm).sum(axis=1))
    nx = np.sqrt((xm * xm).sum(axis=1))
    denom = nq * nx
    return np.where(denom == 0, 1.0, 1.0 - dots / np.where(denom == 0, 1.0, denom))


def _approx(q: _Questions, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fast distances of every (question, row) by one matrix product, shifted
    by a per-question constant (which keeps each question's order), and the
    per-question bound on their rounding error."""
    if q.metric == "l2sq":  # |q|^2 + |x|^2 - 2 q.x, without the |q|^2 term
        xsq = (x * x).sum(axis=1)
        g = np.hstack([-2.0 * q.mat, np.ones((len(q.mat), 1))]) @ np.hstack([x, xsq[:, None]]).T
        return g, _TOL * (q.sq + xsq.max() + 1.0)
    xn = np.sqrt((x * x).sum(axis=1))
    if q.metric == "cosine":  # 1 - cos, without the 1
        g = q.unit @ (x / np.where(xn == 0, 1.0, xn)[:, None]).T
        np.negative(g, out=g)
        g[:, xn == 0] = 0.0
        g[q.norm == 0, :] = 0.0
        return g, np.full(len(q.ids), _TOL * 4)
    g = q.mat @ x.T  # 1 - q.x, without the 1
    np.negative(g, out=g)
    return g, _TOL * (q.norm * xn.max() + 1.0)


def _prune(cands: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of each question, ties by id: what the global ranking keeps at most."""
    return cands.sort_values(["_qi", "distance", "id"], kind="stable").groupby("_qi").head(k)


class _Nearest:
    """Running top-k (ties included) of a block of questions.

    A running k-th best approximate distance per question is kept with a
    vectorised ``np.partition`` merge; a row becomes a candidate (exact
    distance recomputed) only if its approximate distance is within twice the
    rounding bound of that running value, so after the first chunks only rows
    that can still enter a top-k cost anything.
    """

    def __init__(self, q: _Questions, k: int):
        nq = len(q.ids)
        self.q, self.k = q, k
        self.best = np.full((nq, k), np.inf)
        self.kth = np.full(nq, np.inf)
        self.tol = np.zeros(nq)
        self.kept, self.held = [], 0

    def add(self, ids: np.ndarray, x: np.ndarray, only: np.ndarray | None = None) -> None:
        """Rows for all questions of the block, or for those at ``only``."""
        q = (self.q if only is None else self.q.some(only)).wide()
        at = np.arange(len(self.q.ids)) if only is None else only
        approx, t = _approx(q, x)
        tol = self.tol[at] = np.maximum(self.tol[at], t)
        if not np.isfinite(self.kth[at]).all():  # until every question has k rows: merge the whole chunk
            self.best[at] = np.partition(np.concatenate([self.best[at], approx], axis=1), self.k - 1, axis=1)[:, :self.k]
            self.kth[at] = self.best[at].max(axis=1)
            qi, xj = np.nonzero(approx <= (self.kth[at] + 2 * tol)[:, None])
        else:  # then only rows under the running k-th are candidates, and only they are merged
            qi, xj = np.nonzero(approx <= (self.kth[at] + 2 * tol)[:, None])
            if len(qi):
                touched, first, where, count = np.unique(qi, return_index=True, return_inverse=True, return_counts=True)
                merged = np.full((len(touched), self.k + count.max()), np.inf)
                merged[:, :self.k] = self.best[at[touched]]
                merged[where, self.k + np.arange(len(qi)) - first[where]] = approx[qi, xj]
                best = np.partition(merged, self.k - 1, axis=1)[:, :self.k]
                self.best[at[touched]] = best
                self.kth[at[touched]] = best.max(axis=1)
        if not len(qi):
            return
        exact = np.empty(len(qi))
        step = max(1, min(_PAIRS, _CELLS // max(1, x.shape[1])))
        for s in range(0, len(qi), step):  # also a chunk of equal rows is no matrix of all its pairs' vectors
            some = slice(s, s + step)
            exact[some] = _exact(q.mat[qi[some]], x[xj[some]], q.metric)
        self.kept.append(pd.DataFrame({"_qi": at[qi], "id": ids[xj], "distance": exact}))
        self.held += len(qi)
        if self.held > 2 * self.k * len(self.q.ids) + 4096:  # also after one chunk of equal rows
            self.kept = [_prune(pd.concat(self.kept, ignore_index=True), self.k)]
            self.held = len(self.kept[0])

    def result(self) -> pd.DataFrame | None:
        return _prune(pd.concat(self.kept, ignore_index=True), self.k) if self.kept else None


class _TopK:
    """Local top-k of every question over the rows of a task, in blocks of bounded distance matrices.

    ``add`` may name the questions that rows are for (a mask over all of them); what is held is ``k`` rows a
    question and a step's matrices, however many rows come."""

    def __init__(self, q: _Questions, k: int):
        self.starts = range(0, len(q.ids), _STEP)
        self.blocks = [_Nearest(q.some(slice(s, s + _STEP)), k) for s in self.starts]

    def add(self, xids: np.ndarray, x: np.ndarray, only: np.ndarray | None = None) -> None:
        asked = [None if only is None else np.flatnonzero(only[s:s + _STEP]) for s in self.starts]
        widest = max((len(b.q.ids) if a is None else len(a) for a, b in zip(asked, self.blocks)), default=0)
        rows = max(1, _CELLS // max(1, widest))
        for s in range(0, x.shape[0], rows):
            xs, ids = x[s:s + rows].astype(np.float64, copy=False), xids[s:s + rows]
            for block, some in zip(self.blocks, asked):
                if some is None or len(some):
                    block.add(ids, xs, some)

    def results(self) -> Iterator[pd.DataFrame]:
        """What was found block by block; a block is let go with what it held."""
        for i, s in enumerate(self.starts):
            found, self.blocks[i] = self.blocks[i].result(), None
            if found is not None:
                yield found.assign(_qi=found["_qi"] + s)

    def result(self) -> pd.DataFrame:
        parts = [*self.results()]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"_qi": [], "id": [], "distance": []})


def _scanned(q: _Questions, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> _TopK:
    nearest = _TopK(q, k)
    for xids, x in batches:
        nearest.add(xids, x)
    return nearest


def _scan_topk(q: _Questions, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """Local top-k (ties included) of every question over the rows of a task."""
    return _scanned(q, batches, k).result()


def _no_rows(qid: str, id_col: str) -> pd.DataFrame:
    """An empty result whose (object) columns convert to any Spark type."""
    return pd.DataFrame({qid: pd.Series([], dtype=object), id_col: pd.Series([], dtype=object),
                         "distance": pd.Series([], dtype="float64")})


def _global_topk(cands: DataFrame, qid: str, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.col("distance"), F.col(id_col))
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(questions: DataFrame, corpus: DataFrame, k: int = 5, metric: str = "l2sq",
         qid: str = "question_id", qvec: str = "embedding", id_col: str = "id",
         vec: str = "embedding", max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
         corpus_blocks: int | None = None, checkpoint_questions: bool = True) -> DataFrame:
    """``(qid, id, rank, distance)``: the ``k`` nearest corpus rows per question.

    A question with fewer than ``k`` corpus rows gets them all; an empty corpus
    gives no row.  Nearest first; ties in distance break on ``id``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = questions.sparkSession
    qsel = questions.select(F.col(qid), F.col(qvec).alias("_qv")).where(F.col("_qv").isNotNull())
    # the question side is read by the size check and then by the search:
    # checkpoint it (shared folder) so its upstream work runs once, unless
    # the caller already materialised it
    if checkpoint_questions:
        qsel = materialize(qsel)
    stats = qsel.agg(F.count("*").alias("n"), F.max(F.size("_qv")).alias("dmax"),
                     F.min(F.size("_qv")).alias("dmin")).first()
    n, dim = stats["n"], stats["dmax"]
    id_type = corpus.schema[id_col].dataType
    qid_type = questions.schema[qid].dataType
    out = T.StructType([T.StructField(qid, qid_type), T.StructField(id_col, id_type),
                        T.StructField("distance", T.DoubleType())])
    if n == 0:
        return spark.createDataFrame([], out.add("rank", T.IntegerType()))
    if stats["dmin"] != dim:
        raise ValueError(f"questions mix vector dimensions {stats['dmin']} and {dim}")
    csel = corpus.select(F.col(id_col), F.col(vec).alias("_cv")).where(F.col("_cv").isNotNull())
    size = n * dim * 8
    if size <= max_broadcast_bytes:
        cands = _broadcast_scan(spark, qsel, csel, qid, id_col, dim, k, metric, out)
    else:
        side = min(GRID_BYTES, max(1, max_broadcast_bytes))  # a group holds both sides, as Arrow, objects and matrices
        blocks = math.ceil(size / side)
        cblocks = corpus_blocks or max(1, math.ceil(csel.count() * dim * 8 / side))
        cands = _grid_scan(qsel, csel, qid, id_col, dim, k, metric, out, blocks, cblocks)
    return _global_topk(cands, qid, id_col, k).select(qid, id_col, "rank", "distance")


def _broadcast_scan(spark, qsel, csel, qid, id_col, dim, k, metric, out) -> DataFrame:
    qpdf = qsel.toPandas()  # size checked by the caller
    bq = spark.sparkContext.broadcast((qpdf[qid].to_numpy(), _as_matrix(qpdf["_qv"], dim, _element(qsel.schema["_qv"].dataType))))
    of_rows = _element(csel.schema["_cv"].dataType)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat = bq.value
        q = _Questions(ids, mat, metric)
        nearest = _scanned(q, ((b[id_col].to_numpy(), _as_matrix(b["_cv"], dim, of_rows)) for b in batches), k)
        for res in nearest.results():  # a task without corpus rows emits nothing
            yield pd.DataFrame({qid: q.ids[res["_qi"].to_numpy(dtype=np.int64)],
                                id_col: res["id"].to_numpy(), "distance": res["distance"].to_numpy()})

    return csel.mapInPandas(scan, out)


def _grid_scan(qsel, csel, qid, id_col, dim, k, metric, out, qblocks, cblocks) -> DataFrame:
    corpus_rep = csel.select(
        "*",
        F.pmod(F.xxhash64(id_col, "_cv"), F.lit(cblocks)).cast("int").alias("_cb"),
        F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("_qb"),
    )
    q_rep = qsel.select(
        "*",
        F.pmod(F.xxhash64(qid, "_qv"), F.lit(qblocks)).cast("int").alias("_qb"),
        F.explode(F.sequence(F.lit(0), F.lit(cblocks - 1))).alias("_cb"),
    )

    of_rows, of_questions = _element(csel.schema["_cv"].dataType), _element(qsel.schema["_qv"].dataType)

    def pair(corp: pd.DataFrame, ques: pd.DataFrame) -> pd.DataFrame:
        if corp.empty or ques.empty:
            return _no_rows(qid, id_col)
        q = _Questions(ques[qid].to_numpy(), _as_matrix(ques["_qv"], dim, of_questions), metric)
        res = _scan_topk(q, iter([(corp[id_col].to_numpy(), _as_matrix(corp["_cv"], dim, of_rows))]), k)
        return pd.DataFrame({qid: q.ids[res["_qi"].to_numpy(dtype=np.int64)],
                             id_col: res["id"].to_numpy(), "distance": res["distance"].to_numpy()})

    return (corpus_rep.groupBy("_qb", "_cb")
            .cogroup(q_rep.groupBy("_qb", "_cb"))
            .applyInPandas(pair, out))


def with_payload(hits: DataFrame, index: DataFrame, id_col: str = "id",
                 payload: tuple[str, ...] = ("text", "metadata"),
                 max_rows: int | None = None, max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Late materialisation: rank on ``(id, vector)`` only, then fetch text and
    metadata for the winning ids (never the vector).

    ``max_rows`` is a proven bound on the hits (questions x k: the global
    ``row_number() <= k`` guarantees it).  Within the broadcast bound the hits
    are the build side of a broadcast join streamed by the index scan, so the
    index is filtered where it is read and never shuffled with its text.
    Without a bound in bytes it is an ordinary join.
    """
    docs = index.select(id_col, *payload)
    small = max_rows is not None and max_rows * HIT_BYTES <= max_broadcast_bytes
    return docs.join(F.broadcast(hits) if small else hits, id_col, "inner").select(*hits.columns, *payload)


def search_topk(questions: DataFrame, corpus: DataFrame, k: int, metric: str, qid: str,
                method: str = "exact", n_lists: int | None = None,
                checkpoint_questions: bool = True) -> DataFrame:
    """Top-k by a scan, or through inverted lists when ``method='ivf'``."""
    if method == "exact":
        return topk(questions, corpus, k=k, metric=metric, qid=qid,
                    checkpoint_questions=checkpoint_questions)
    if method == "ivf":
        from chatlore.operators.ivf import topk_ivf

        return topk_ivf(questions, corpus, k=k, metric=metric, qid=qid, n_lists=n_lists)
    raise ValueError("search must be 'exact' or 'ivf'")
