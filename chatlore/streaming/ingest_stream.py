"""Incremental ingestion as Structured Streaming.

The reference re-runs its batch ingestion by hand; here new message and
reply files are picked up as they land.  A new reply changes an old thread's
document, so every micro-batch collects the touched document keys and
rebuilds those documents from the *full* landed tables (never by appending
to the old text), then embeds and upserts them.  The touched keys become partition filters on both
landings (``chat.land_messages``, ``chat.land_replies``: channel and day), so a micro-batch reads the
partitions of its threads and rewrites those of the index.  The page cap of the batch
loader does not apply to incremental runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore import schemas
from chatlore.config import Params
from chatlore.operators import documents as D
from chatlore.plans.ingest import embedded_documents
from chatlore.session import materialize
from chatlore.sources import chat
from chatlore.sources.vector_index import VectorIndex


def _touched_keys(spark: SparkSession, messages_path: str, replies_path: str) -> DataFrame:
    """``(channel_id, key_ts)`` of what lands; both landings may have day partitions."""
    def landing(schema, path, key):
        rows = spark.readStream.schema(T.StructType([*schema.fields, chat.DAY])).parquet(path)
        return rows.select("channel_id", F.col(key).alias("key_ts"))

    return landing(schemas.LANDED_MESSAGES, messages_path, "ts").unionByName(
        landing(schemas.REPLIES, replies_path, "thread_ts"))


def touched_parents(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """The top-level messages whose ts or thread is among ``keys`` (``channel_id, key_ts``); of repeated
    ``(channel, ts)`` the least row by content, whatever the order of arrival."""
    by_ts = messages.join(keys.withColumnRenamed("key_ts", "ts"), ["channel_id", "ts"], "left_semi")
    by_thread = messages.join(keys.withColumnRenamed("key_ts", "thread_ts"), ["channel_id", "thread_ts"], "left_semi")
    rest = [c for c in messages.columns if c not in ("channel_id", "ts")]
    return (by_ts.unionByName(by_thread).groupBy("channel_id", "ts").agg(F.min(F.struct(*rest)).alias("_r"))
            .select("channel_id", "ts", "_r.*").select(*messages.columns))


def _rebuild(spark: SparkSession, messages_path: str, replies_path: str, users: DataFrame,
             index: VectorIndex, params: Params, embedder):
    def run(keys: DataFrame, batch_id: int) -> None:
        keys = materialize(keys.distinct())
        parents = touched_parents(chat.read_messages(spark, messages_path, keys), keys)
        # a parent found by its ts has a thread of its own; one found by its thread has that of the key
        threads = parents.where("thread_ts IS NOT NULL").select("channel_id", F.col("thread_ts").alias("key_ts"))
        threads = materialize(threads.unionByName(keys).distinct())
        replies = chat.read_replies(spark, replies_path, threads)
        docs = D.load_documents(parents, replies, users, params)
        emb = embedded_documents(docs.drop("pos"), params, embedder)
        index.upsert(emb.where(F.col("embed_status") == "ok").drop("embed_status", "embed_error"))

    return run


def start(spark: SparkSession, messages_path: str, replies_path: str, users: DataFrame, index: VectorIndex,
          work_dir: str, params: Params = Params(history_cap=None), embedder=None,
          max_files_per_trigger: int | None = None, available_now: bool = True):
    keys = _touched_keys(spark, messages_path, replies_path)
    w = (keys.writeStream.foreachBatch(_rebuild(spark, messages_path, replies_path, users, index,
                                                params, embedder))
         .option("checkpointLocation", f"{work_dir}/_chk_ingest"))
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
