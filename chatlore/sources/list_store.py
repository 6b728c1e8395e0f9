"""Inverted lists that are stored with the vectors (F2, U3): trained and assigned once, searched many times.

``build`` writes a version of the store:

* ``v=<n>/rows/_list=<l>``: ids and vectors by list, so that a search opens the files of the lists it needs only;
* ``v=<n>/lists``: centroid, radius, rows and files of every list, read back from the written rows.  Its
  ``_SUCCESS`` is the version's commit; readers use the newest version that has one, and a lost executor or a
  failed build leaves them at the version before.

Centroids come from k-means over all rows,
or over about ``TRAIN_ROWS`` rows a list, chosen by id hash, where there are more, so training is bounded.  Every row is
indexed.  Radii are those of all rows, so the sample decides how much is pruned, never what is found: rows are those
of the exact search.

``topk`` trains nothing.  It reads the table of lists (at most ``MAX_LISTS`` rows, the only data sent to the tasks without a
check of its size), picks per question the lists that can hold a neighbour, and scans their files.  Questions and the lists
they read are a broadcast while their bytes allow, so that the vectors aren't shuffled; beyond that, lists and questions
meet in groups of bounded size (``ivf.meet_lists``).  Either way no group or task holds all questions or all rows.

Null vectors aren't stored and null question vectors find nothing; a store without rows (or that was never built) gives no
rows.  Ties in distance break on the id.  All vectors have one dimension, others are an error.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore.operators.ivf import lists_to_read, meet_lists, nearest_list
from chatlore.operators.knn import DEFAULT_BROADCAST_BYTES, _as_matrix, _global_topk, _Questions, _scan_topk
from chatlore.session import materialize
from chatlore.sources.vector_index import committed_versions

MAX_LISTS = 16_384           # 8 MiB of centroids of 64 numbers
TRAIN_ROWS = 256             # rows a list that the centroids are trained on
LISTS = T.StructType([
    T.StructField("_list", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType())),
    T.StructField("radius", T.DoubleType()), T.StructField("rows", T.LongType()), T.StructField("files", T.LongType()),
])


@dataclass(frozen=True)
class Read:
    """What a search opened, of what is stored."""

    lists: int
    all_lists: int
    files: int
    all_files: int
    rows: int
    all_rows: int


class ListStore:
    """Vectors by inverted list in a directory, for ``l2sq`` or ``cosine`` distances."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "l2sq", id_col: str = "id", vec: str = "embedding",
                 max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES):
        if metric not in ("l2sq", "cosine"):
            raise ValueError("inverted lists need l2sq or cosine distances")
        self.spark, self.path, self.metric, self.id_col, self.vec = spark, path.rstrip("/"), metric, id_col, vec
        self.max_broadcast_bytes = max_broadcast_bytes
        self.last_read: Read | None = None

    # -- build ----------------------------------------------------------------------------------

    def _centroids(self, rows: DataFrame, n: int, n_lists: int, seed: int, max_iter: int) -> np.ndarray:
        want = n_lists * TRAIN_ROWS
        some = rows if n <= want else rows.where(F.pmod(F.xxhash64(self.id_col), F.lit(n)) < want)
        train = some.select(array_to_vector("_cv").alias("_v"))
        if self.metric == "cosine":
            train = Normalizer(inputCol="_v", outputCol="_f").transform(train).select(F.col("_f").alias("_v"))
        model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="_list").fit(materialize(train))
        return np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])

    def build(self, corpus: DataFrame, n_lists: int | None = None, seed: int = 42, max_iter: int = 10) -> int:
        """Store the corpus as a new version, whose number is returned."""
        rows = corpus.select(F.col(self.id_col), F.col(self.vec).alias("_cv")).where(F.col("_cv").isNotNull())
        n = rows.count()
        version = max(self.versions(), default=0) + 1
        folder, metric = f"{self.path}/v={version}", self.metric
        if n == 0:
            self.spark.createDataFrame([], LISTS).write.mode("overwrite").parquet(f"{folder}/lists")
            return self._commit(folder, version)
        centroids = self._centroids(rows, n, max(2, min(n, MAX_LISTS, n_lists or math.isqrt(n))), seed, max_iter)
        shared = self.spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not pdf.empty:
                    near, away = nearest_list(_as_matrix(pdf["_cv"], shared.value.shape[1]), shared.value, metric)
                    yield pdf.assign(_list=near, _away=away)

        (rows.mapInPandas(assign, T.StructType([*rows.schema.fields, T.StructField("_list", T.IntegerType()),
                                                T.StructField("_away", T.DoubleType())]))
         .hint("rebalance", "_list")        # a list in few files, a hot one in several tasks
         .write.mode("overwrite").partitionBy("_list").parquet(f"{folder}/rows"))
        stored = self.spark.read.parquet(f"{folder}/rows")
        sizes = stored.groupBy("_list").agg(F.max("_away").alias("radius"), F.count(F.lit(1)).alias("rows"),
                                            F.count_distinct(F.col("_metadata.file_path")).alias("files"))
        at = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], T.StructType(LISTS.fields[:2]))
        (at.join(sizes, "_list").select(*LISTS.fieldNames()).coalesce(1)       # at most MAX_LISTS rows
         .write.mode("overwrite").parquet(f"{folder}/lists"))
        return self._commit(folder, version)

    def _commit(self, folder: str, version: int) -> int:
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(done, True).close()
        return version

    def versions(self) -> list[int]:
        return committed_versions(self.spark, self.path)

    # -- search ---------------------------------------------------------------------------------

    def lists(self, version: int | None = None) -> DataFrame:
        """The table of lists of a version (the newest by default)."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return self.spark.createDataFrame([], LISTS)
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/v={version}/lists")

    def topk(self, questions: DataFrame, k: int = 5, qid: str = "question_id", qvec: str = "embedding",
             version: int | None = None, max_group_rows: int = 100_000, max_group_questions: int = 20_000) -> DataFrame:
        """``(qid, id, rank, distance)``: the ``k`` nearest stored rows per question.  ``last_read`` says what was opened."""
        version = max(self.versions(), default=None) if version is None else version
        table = self.lists(version).orderBy("_list").collect() if version else []       # at most MAX_LISTS rows
        qid_field = questions.schema[qid]
        if not table:
            self.last_read = Read(0, 0, 0, 0, 0, 0)
            id_type = T.StringType()
            return self.spark.createDataFrame([], T.StructType([qid_field, T.StructField(self.id_col, id_type), T.StructField(
                "rank", T.IntegerType()), T.StructField("distance", T.DoubleType())]))
        names = np.array([r["_list"] for r in table], np.int32)
        about = (np.array([r["centroid"] for r in table]), np.array([r["radius"] for r in table]), np.array([r["rows"] for r in table]))
        shared = self.spark.sparkContext.broadcast(about)
        metric, dim = self.metric, len(table[0]["centroid"])

        def reached(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
            for s in range(0, len(pdf), 256):
                some = pdf.iloc[s:s + 256]
                yield some, *lists_to_read(_as_matrix(some["_qv"], dim), *shared.value, k, metric)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(len(names), np.int64)
            for pdf in batches:
                for _, _, near in reached(pdf):
                    n += np.bincount(near, minlength=len(names))
            yield pd.DataFrame({"_list": names[n > 0], "n": n[n > 0]})

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for some, who, near in reached(pdf):
                    yield pd.DataFrame({qid: some[qid].to_numpy()[who], "_qv": some["_qv"].to_numpy()[who], "_list": names[near]})

        asked = materialize(questions.select(F.col(qid), F.col(qvec).alias("_qv")).where(F.col("_qv").isNotNull()))
        per_list = {r["_list"]: r["n"] for r in asked.mapInPandas(count, "_list int, n long").groupBy("_list").agg(
            F.sum("n").alias("n")).collect()}
        read = [r for r in table if r["_list"] in per_list]
        self.last_read = Read(len(read), len(table), sum(r["files"] for r in read), sum(r["files"] for r in table),
                              sum(r["rows"] for r in read), sum(r["rows"] for r in table))
        rows = (self.spark.read.parquet(f"{self.path}/v={version}/rows").where(F.col("_list").isin(sorted(per_list)))
                .select(self.id_col, "_cv", "_list"))
        if sum(per_list.values()) * dim * 8 <= self.max_broadcast_bytes:
            probes = asked.mapInPandas(probe, T.StructType([
                qid_field, T.StructField("_qv", questions.schema[qvec].dataType), T.StructField("_list", T.IntegerType())]))
            found = self._scan(rows, probes, qid, qid_field, dim, k)
        else:
            found = meet_lists(rows, asked, qid, self.id_col, (names, *about), dim, metric, k, max_group_rows, max_group_questions)
        return _global_topk(found, qid, self.id_col, k).select(qid, self.id_col, "rank", "distance")

    def _scan(self, rows: DataFrame, probes: DataFrame, qid: str, qid_field: T.StructField, dim: int, k: int) -> DataFrame:
        asked = probes.toPandas().sort_values("_list", kind="stable")      # size checked by the caller
        shared = self.spark.sparkContext.broadcast((asked["_list"].to_numpy(), asked[qid].to_numpy(), _as_matrix(asked["_qv"], dim)))
        id_col, metric = self.id_col, self.metric

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of_list, ids, vectors = shared.value
            pieces = ((name, part) for pdf in batches for name, part in pdf.groupby("_list", sort=False))
            for name, parts in itertools.groupby(pieces, key=lambda p: p[0]):
                some = slice(*np.searchsorted(of_list, [name, name + 1]))
                q = _Questions(ids[some], vectors[some], metric)
                res = _scan_topk(q, ((p[id_col].to_numpy(), _as_matrix(p["_cv"], dim)) for _, p in parts), k)
                if len(res):
                    yield pd.DataFrame({qid: q.ids[res["_qi"].to_numpy(dtype=np.int64)],
                                        id_col: res["id"].to_numpy(), "distance": res["distance"].to_numpy()})

        return rows.mapInPandas(scan, T.StructType([qid_field, rows.schema[id_col], T.StructField("distance", T.DoubleType())]))
