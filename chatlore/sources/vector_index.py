"""Upsertable vector index on Parquet, rewritten by partition.

Layout::

    <root>/<collection>/data/w=<n>/p_channel=<c>/p_day=<d>/   rows that upsert n wrote
    <root>/<collection>/v=<n>/                                 manifest of version n

A version is the list of the partitions (channel and day of the message) it consists of, each with
the upsert that wrote it last.  An upsert rewrites the partitions that its batch touches into a folder
of its own and then writes the next manifest; other partitions' files are neither read nor copied.
The manifest's commit (``_SUCCESS``) is the upsert's: a lost executor or a failed job leaves the index at
the version before, and older versions stay readable until ``drop_versions``.

Rows: ``id, text, metadata, embedding, content_hash``.  Upsert semantics:
insert new ids, replace text/metadata/embedding of existing ids, never
delete; an empty batch writes nothing.

An id of the loader is a digest of its channel and ts (``functions.text.doc_id``), so it can only be in
their partition.  Other ids may move between partitions: the manifest says which partitions hold such
ids, and only for those the narrow id column is searched for the batch's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore import schemas
from chatlore.functions.text import doc_id, ts_order
from chatlore.operators import knn
from chatlore.session import materialize

ROW_BYTES = 64               # of a broadcast row besides its id
DEFAULT_COLLECTION = "local_knowledge"

#: Partition folders named one by one in a read; with more, a join with the manifest picks the rows.
MAX_FOLDERS = 10_000

INDEX_SCHEMA = T.StructType(list(schemas.DOCUMENTS.fields) + [T.StructField("content_hash", schemas.S, True)])


PLACE = ["p_channel", "p_day"]
_PLACE_FIELDS = [T.StructField(c, schemas.S, False) for c in PLACE]
MANIFEST_SCHEMA = T.StructType([*_PLACE_FIELDS, T.StructField("w", schemas.L, False), T.StructField("n_rows", schemas.L, False),
                                T.StructField("by_place", T.BooleanType(), False)])
_STORED = T.StructType([*INDEX_SCHEMA.fields, T.StructField("w", schemas.L, False), *_PLACE_FIELDS])


def places(days: int = 1) -> list[F.Column]:
    """The partition of an index row: its channel (a digest unless it is a plain name) and the number
    of its day, or ``none``."""
    channel, day = F.col("metadata.channel_id"), F.floor(ts_order("metadata.timestamp") / (86_400 * days))
    return [F.when(channel.isNull(), "none").when(channel.rlike("^[A-Za-z0-9_-]{1,64}$"), F.concat(F.lit("c-"), channel))
            .otherwise(F.concat(F.lit("h-"), F.md5(channel))).alias("p_channel"),
            F.coalesce(day.cast("string"), F.lit("none")).alias("p_day")]


def by_place() -> F.Column:
    """Whether a row's id is the digest of its channel and ts, and so bound to its partition."""
    return F.coalesce(F.col("id") == doc_id("metadata.channel_id", "metadata.timestamp"), F.lit(False))


def content_hash(text: F.Column, metadata: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("\u0001", F.coalesce(text, F.lit("")), F.to_json(metadata)), 256)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Snapshot numbers whose write committed, ascending."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def dedup_batch(batch: DataFrame) -> DataFrame:
    """One row per id inside a batch: newest ``metadata.timestamp``, then the
    lowest content hash.  ``min_by`` is a partial aggregate, so a batch where
    one id repeats a huge number of times collapses map-side."""
    order = F.struct(
        (-F.coalesce(F.col("metadata.timestamp").try_cast("decimal(20,6)"), F.lit(0))).alias("t"),
        F.col("content_hash").alias("h"),
    )
    cols = [c for c in batch.columns if c != "id"]
    picked = batch.groupBy("id").agg(F.min_by(F.struct(*cols), order).alias("_r"))
    return picked.select("id", *[F.col(f"_r.{c}").alias(c) for c in cols])


class VectorIndex:
    """A named collection in a directory; created empty when missing.  ``days`` is the width of a
    partition; it must stay the same for a collection."""

    def __init__(self, spark: SparkSession, directory: str, collection: str = DEFAULT_COLLECTION,
                 days: int = 1, max_broadcast_bytes: int = 64 << 20):
        self.spark = spark
        self.path = f"{directory.rstrip('/')}/{collection}"
        self.days = days
        self.max_broadcast_bytes = max_broadcast_bytes

    def versions(self) -> list[int]:
        return committed_versions(self.spark, self.path)

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def manifest(self, version: int | None = None) -> DataFrame:
        """The partitions of a version (the current one by default): ``p_channel, p_day, w, n_rows, by_place``."""
        version = self.current_version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/v={version}")

    def _rows(self, parts: DataFrame) -> DataFrame:
        """The rows of some partitions of a manifest, with ``w`` and the partition columns.  The folders
        are read by name, so the files of others aren't opened; beyond ``MAX_FOLDERS`` the folders of the
        upserts in question are read and joined with ``parts``."""
        named = parts.select("w", *PLACE).limit(MAX_FOLDERS + 1).collect()
        if not named:
            return self.spark.createDataFrame([], _STORED)
        data = f"{self.path}/data"
        reader = self.spark.read.schema(_STORED).option("basePath", data)
        if len(named) <= MAX_FOLDERS:
            return reader.parquet(*[f"{data}/w={r.w}/p_channel={r.p_channel}/p_day={r.p_day}" for r in named])
        written = [r.w for r in parts.select("w").distinct().collect()]   # one per upsert that still has rows
        return reader.parquet(*[f"{data}/w={w}" for w in written]).join(parts.select("w", *PLACE), ["w", *PLACE], "left_semi")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (current by default); an empty frame if none exists."""
        version = self.current_version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], INDEX_SCHEMA)
        return self._rows(self.manifest(version)).select(*INDEX_SCHEMA.fieldNames())

    def count(self) -> int:
        return self.read().count()

    def _next_version(self) -> int:
        """One past the highest folder, committed or not: what a crashed write left behind is never
        read and never in the way."""
        taken = [0]
        for folder, prefix in ((self.path, "v="), (f"{self.path}/data", "w=")):
            fs, p = _fs(self.spark, folder)
            names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
            taken += [int(n[2:]) for n in names if n.startswith(prefix)]
        return 1 + max(taken)

    def search(self, questions: DataFrame, k: int = 5, metric: str = "l2sq", qid: str = "question_id") -> DataFrame:
        """``(qid, rank, id, distance, text, metadata)``: the ``k`` nearest rows of the current snapshot."""
        index = self.read()
        return knn.with_payload(knn.topk(questions, index.select("id", "embedding"), k=k, metric=metric, qid=qid), index)

    def _small(self, ids: DataFrame, n_bytes: int | None) -> DataFrame:
        return F.broadcast(ids) if (n_bytes or 0) <= self.max_broadcast_bytes else ids

    def upsert(self, docs: DataFrame, unique: bool = False) -> int | None:
        """Write version ``n+1`` = current with ``docs`` inserted/replaced by id.

        The partitions that hold an id of the batch, or get one, are rewritten without the batch's
        ids and with its rows; all others are only named again in the manifest.  ``unique``: the ids of
        ``docs`` are known to differ.  Returns the new version, or None for an empty batch.
        """
        batch = docs
        if "content_hash" not in batch.columns:
            batch = batch.withColumn("content_hash", content_hash(F.col("text"), F.col("metadata")))
        batch = batch.select(*INDEX_SCHEMA.fieldNames())
        batch = batch if unique else dedup_batch(batch)
        batch = batch.select(*[F.col(f.name).cast(f.dataType) for f in INDEX_SCHEMA.fields]).select("*", *places(self.days))
        # materialise the batch once in the shared folder: its size, places and ids and the union all
        # read it, and the work upstream (embedding) must not run again
        batch = materialize(batch)
        size = batch.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("id") + ROW_BYTES).alias("bytes"),
                         F.min(by_place()).alias("by_place")).first()
        if not size["n"]:
            return None
        nxt, old = self._next_version(), self.manifest()
        ids = self._small(batch.select("id"), size["bytes"])
        # a batch id that is no digest of its place may be anywhere, one that is only where others are not
        searched = old if not size["by_place"] else old.where(~F.col("by_place"))
        held = self._rows(searched).select("id", *PLACE).join(ids, "id", "left_semi").select(*PLACE)
        touched = materialize(batch.select(*PLACE).unionByName(held).distinct())
        kept = self._rows(old.join(touched, PLACE, "left_semi")).drop("w").join(ids, "id", "left_anti")
        target = f"{self.path}/data/w={nxt}"
        # a partition is one file, or several of the advised size where it is large
        (kept.unionByName(batch).hint("rebalance", *[F.col(c) for c in PLACE])
         .write.mode("error").partitionBy(*PLACE).parquet(target))
        fresh = (self.spark.read.schema(_STORED).option("basePath", f"{self.path}/data").parquet(target)
                 .groupBy(*PLACE, "w").agg(F.count(F.lit(1)).alias("n_rows"), F.min(by_place()).alias("by_place")))
        (old.join(touched, PLACE, "left_anti").unionByName(fresh).select(*MANIFEST_SCHEMA.fieldNames())
         .write.mode("error").parquet(f"{self.path}/v={nxt}"))
        return nxt

    def drop_versions(self, keep: int = 1) -> list[int]:
        """Forget all but the newest ``keep`` versions and delete the partitions that none of those
        names, and what failed upserts left.  Returns the versions that went.  No upsert may run meanwhile."""
        versions = self.versions()
        gone, stay = versions[:-keep], versions[-keep:]
        fs, data = _fs(self.spark, f"{self.path}/data")
        named: dict[int, bool] = {}
        if stay:
            live = self.manifest(stay[0])
            for v in stay[1:]:
                live = live.unionByName(self.manifest(v))
            named = {r.w: True for r in live.select("w").distinct().collect()}
            for v in gone:   # partitions that later upserts have rewritten, in folders that stay
                dead = (self.manifest(v).join(live, ["w", *PLACE], "left_anti")
                        .where(F.col("w").isin(list(named))).select("w", *PLACE).distinct())
                for r in dead.toLocalIterator():
                    fs.delete(_fs(self.spark, f"{self.path}/data/w={r.w}/p_channel={r.p_channel}/p_day={r.p_day}")[1], True)
        for v in gone:
            fs.delete(_fs(self.spark, f"{self.path}/v={v}")[1], True)
        for st in fs.listStatus(data) if fs.exists(data) else []:
            name = st.getPath().getName()
            if name.startswith("w=") and int(name[2:]) not in named:
                fs.delete(st.getPath(), True)
        return gone

    def changed(self, docs: DataFrame) -> DataFrame:
        cur = self.read().select("id", "content_hash")
        return docs.join(cur, ["id", "content_hash"], "left_anti")
