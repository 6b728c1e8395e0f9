"""A second vector store, by hashing (F2, U3): ``BucketedRandomProjectionLSH`` tables behind the interface of ``ListStore``.

``build`` draws ``tables`` times ``width`` random directions (one fitted Spark model, saved with the version) and writes
every row once per table, under the bucket that its ``width`` projections fall in, sorted by bucket:

* ``v=<n>/rows/_t=<t>``: id, vector and ``_list`` (the folded bucket) of every row;
* ``v=<n>/model``, ``v=<n>/facts``: the directions, and rows and dimension; ``_SUCCESS`` is the commit.

The bucket length follows from the data: about ``TUNE_ROWS`` rows, chosen by id hash, are searched exactly when the store is
built, and buckets are made so long that a neighbour as far as ``TUNE_SHARE`` of theirs is met with a chance of ``TARGET``
(a projection moves it by a normal deviate of its distance / sqrt(dimension)).  Every row is hashed and stored.

``topk`` probes, per table, the question's bucket and those beside it.  Rows and questions of a bucket meet in groups of
bounded size (``ivf.meet``), distances are exact, ties break on the id.  Results are approximate: rows that share no
probed bucket are missed; but a question gets ``min(k, rows)`` rows always, as those that the buckets give fewer are
searched exactly.  Buckets are folded to ``BUCKETS`` a table, so that their sizes are a table of bounded size; what meets by
folding only costs time.

Null vectors aren't stored and null question vectors find nothing; under ``cosine`` a question without a direction is
searched exactly.  A store without rows, or never built, gives no rows.  Vectors of several dimensions are an error.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore.operators import knn
from chatlore.operators.ivf import meet
from chatlore.session import materialize
from chatlore.sources.vector_index import committed_versions

BUCKETS = 1 << 16            # of a table
TUNE_ROWS = 256
TUNE_K = 5
TUNE_SHARE = 0.95
TARGET = 0.97
NAMED_LISTS = 1_000          # buckets named in the scan's filter; more are left to the join
FACTS = T.StructType([T.StructField("rows", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("length", T.DoubleType())])


@dataclass(frozen=True)
class Searched:
    """Questions of a search, and those of them that were searched exactly."""

    questions: int
    exact: int


def chance(length: float, tables: int, width: int) -> float:
    """That a row is met whose projections are off by standard normal deviates, with buckets of ``length``."""
    def below(x: float) -> float:
        return (1 + math.erf(x / math.sqrt(2))) / 2

    places = [(k + 0.5) / 64 for k in range(64)]        # of the question in its bucket
    one = sum(below((2 - u) * length) - below(-(1 + u) * length) for u in places) / len(places)
    return 1 - (1 - one ** width) ** tables


def bucket_length(tables: int, width: int, target: float = TARGET) -> float:
    """The least length, in standard deviations, with that chance."""
    low, high = 0.0, 16.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if chance(mid, tables, width) >= target else (mid, high)
    return high


class HashStore:
    """Vectors by hash bucket in a directory, for ``l2sq`` or ``cosine`` distances."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "l2sq", id_col: str = "id", vec: str = "embedding",
                 tables: int = 4, width: int = 2):
        if metric not in ("l2sq", "cosine"):
            raise ValueError("hash buckets need l2sq or cosine distances")
        self.spark, self.path, self.metric, self.id_col, self.vec = spark, path.rstrip("/"), metric, id_col, vec
        self.tables, self.width = tables, width
        self.last_search: Searched | None = None

    # -- hashing --------------------------------------------------------------------------------

    def _direction(self, v: str) -> F.Column:
        """The vector that is hashed: of unit length for ``cosine`` (or zero)."""
        if self.metric == "l2sq":
            return F.col(v)
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.col(v))

    def _hashed(self, df: DataFrame, v: str, model: BucketedRandomProjectionLSHModel) -> DataFrame:
        """``df`` with ``_b``, the bucket of every projection."""
        hashed = model.transform(df.withColumn("_v", array_to_vector(self._direction(v))))
        places = [vector_to_array(F.col("_h")[k])[0].cast("long").alias(f"_{k}") for k in range(self.tables * self.width)]
        return hashed.select(*df.columns, F.array(*places).alias("_b"))

    def _bucket(self, table: int, beside: tuple[int, ...]) -> F.Column:
        at = [F.col("_b")[table * self.width + k] + F.lit(step) for k, step in enumerate(beside)]
        return (F.pmod(F.xxhash64(F.lit(table), *at), F.lit(BUCKETS)) + F.lit(table * BUCKETS)).cast("int")

    # -- build ----------------------------------------------------------------------------------

    def _reach(self, rows: DataFrame, n: int) -> float:
        """How far the neighbours are that the buckets are made for."""
        asked = rows.where(F.pmod(F.xxhash64(self.id_col), F.lit(n)) < TUNE_ROWS).select(
            F.monotonically_increasing_id().alias("_q"), F.col("_cv").alias("embedding"))
        near = knn.topk(asked, rows, k=TUNE_K + 1, metric=self.metric, qid="_q", id_col=self.id_col, vec="_cv")
        away = F.sqrt(F.greatest(F.col("distance"), F.lit(0.0)) * (1 if self.metric == "l2sq" else 2))
        return near.agg(F.percentile(away, F.lit(TUNE_SHARE))).first()[0] or 1.0

    def build(self, corpus: DataFrame, seed: int = 42) -> int:
        """Store the corpus as a new version, whose number is returned."""
        rows = corpus.select(F.col(self.id_col), F.col(self.vec).cast("array<double>").alias("_cv")).where(F.col("_cv").isNotNull())
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_cv")).alias("least"), F.max(F.size("_cv")).alias("most")).first()
        if sizes["least"] != sizes["most"]:
            raise ValueError(f"vectors of dimensions {sizes['least']} to {sizes['most']}")
        version = max(self.versions(), default=0) + 1
        folder, length = f"{self.path}/v={version}", 0.0
        if sizes["n"]:
            length = self._reach(rows, sizes["n"]) / math.sqrt(sizes["most"]) * bucket_length(self.tables, self.width)
            lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=length, seed=seed,
                                              numHashTables=self.tables * self.width)
            model = lsh.fit(rows.select(array_to_vector("_cv").alias("_v")))      # draws the directions, reads one row
            model.write().overwrite().save(f"{folder}/model")
            same = (0,) * self.width
            entries = F.array(*[F.struct(F.lit(t).alias("_t"), self._bucket(t, same).alias("_list")) for t in range(self.tables)])
            (self._hashed(rows, "_cv", model).select(self.id_col, "_cv", F.inline(entries))
             .repartitionByRange("_t", "_list", F.xxhash64(self.id_col))        # a hot bucket in several files
             .sortWithinPartitions("_t", "_list").write.mode("overwrite").partitionBy("_t").parquet(f"{folder}/rows"))
        facts = self.spark.createDataFrame([(sizes["n"], sizes["most"] or 0, length)], FACTS)
        facts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/facts")
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(done, True).close()
        return version

    def versions(self) -> list[int]:
        return committed_versions(self.spark, self.path)

    # -- search ---------------------------------------------------------------------------------

    def topk(self, questions: DataFrame, k: int = 5, qid: str = "question_id", qvec: str = "embedding",
             version: int | None = None, max_group_rows: int = 100_000, max_group_questions: int = 20_000) -> DataFrame:
        """``(qid, id, rank, distance)``: ``min(k, rows)`` near stored rows per question.  ``last_search`` says how
        many questions were searched exactly."""
        version = max(self.versions(), default=None) if version is None else version
        folder = f"{self.path}/v={version}"
        facts = self.spark.read.schema(FACTS).parquet(f"{folder}/facts").first() if version else None
        if not facts or not facts["rows"]:
            self.last_search = Searched(0, 0)
            return self.spark.createDataFrame([], T.StructType([questions.schema[qid], T.StructField(self.id_col, T.StringType()), T.StructField(
                "rank", T.IntegerType()), T.StructField("distance", T.DoubleType())]))
        model = BucketedRandomProjectionLSHModel.load(f"{folder}/model")
        stored = self.spark.read.parquet(f"{folder}/rows")
        asked = questions.select(F.col(qid), F.col(qvec).cast("array<double>").alias("_qv")).where(F.col("_qv").isNotNull())
        sided = asked if self.metric == "l2sq" else asked.where(F.exists("_qv", lambda x: x != 0))
        steps = [*itertools.product((-1, 0, 1), repeat=self.width)]
        lists = F.array_distinct(F.array(*[self._bucket(t, step) for t in range(self.tables) for step in steps]))
        probes = materialize(self._hashed(sided, "_qv", model).select(qid, "_qv", F.explode(lists).alias("_list")))
        wanted = probes.select("_list").distinct()          # at most tables * BUCKETS numbers
        named = [r["_list"] for r in wanted.limit(NAMED_LISTS + 1).collect()]
        rows = stored.where(F.col("_list").isin(sorted(named))) if len(named) <= NAMED_LISTS else stored.join(
            F.broadcast(wanted), "_list", "left_semi")
        met = meet(rows.select(self.id_col, "_cv", "_list"), probes, qid, self.id_col, questions.schema[qid], stored.schema[self.id_col],
                   facts["dim"], self.metric, k, max_group_rows, max_group_questions)
        once = met.groupBy(qid, self.id_col).agg(F.min("distance").alias("distance"))      # tables find the same rows
        found = materialize(knn._global_topk(once, qid, self.id_col, k).select(qid, self.id_col, "rank", "distance"))
        full = found.groupBy(qid).count().where(F.col("count") >= min(k, facts["rows"]))
        short = materialize(asked.join(full, qid, "left_anti"))
        self.last_search = Searched(asked.count(), short.count())
        if not self.last_search.exact:
            return found
        exact = knn.topk(short, stored.where("_t = 0").select(self.id_col, "_cv"), k, self.metric, qid, "_qv", self.id_col, "_cv",
                         checkpoint_questions=False)
        return found.join(short.select(qid), qid, "left_anti").unionByName(exact)
