"""Batch ingestion (P1, G4): load -> (empty? stop) -> embed -> upsert.

All target channels go through one DAG and one upsert; the reference ran a
Python loop of channels.  Documents whose ``(id, content_hash)`` is already
in the index would be a no-op upsert and are not embedded again.

Error policy: the reference swallowed a failing channel's exception and kept
earlier channels' documents; a Spark job commits all channels or none, so a
failing embedding (``fail_fast=True``) leaves the index unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chatlore.config import Params
from chatlore.operators import documents as D
from chatlore.operators import embed as E
from chatlore.sources.vector_index import VectorIndex, content_hash, dedup_batch


def embedded_documents(docs: DataFrame, params: Params = Params(), embedder=None,
                       fail_fast: bool = True) -> DataFrame:
    with_hash = docs.withColumn("content_hash", content_hash(F.col("text"), F.col("metadata")))
    out = E.embed(with_hash.select("id", "text", "metadata", "content_hash"), "text", embedder,
                  params.dim, fail_fast=fail_fast, model=params.model)
    return out


def ingest(messages: DataFrame, replies: DataFrame, users: DataFrame, index: VectorIndex,
           params: Params = Params(), embedder=None, on_error: str = "skip",
           skip_unchanged: bool = True, observation: Observation | None = None) -> int | None:
    """Run one ingestion; returns the new index version or None (nothing to do).

    ``observation`` (a ``pyspark.sql.Observation``) receives live run counters
    as the job runs: documents loaded and embedded, failed embeddings, text
    characters (the reference logged the same numbers).
    """
    docs = D.load_documents(messages, replies, users, params, on_error=on_error)
    docs = docs.withColumn("content_hash", content_hash(F.col("text"), F.col("metadata")))
    docs = dedup_batch(docs.select("id", "text", "metadata", "content_hash"))   # before the model and without vectors
    if skip_unchanged and index.current_version() is not None:
        docs = index.changed(docs)
    embedded = embedded_documents(docs.drop("content_hash"), params, embedder)
    if observation is not None:
        embedded = embedded.observe(
            observation,
            F.count(F.lit(1)).alias("documents"),
            F.sum((F.col("embed_status") == "ok").cast("long")).alias("embedded"),
            F.sum((F.col("embed_status") != "ok").cast("long")).alias("failed"),
            F.sum(F.length("text")).alias("chars"),
            F.max(F.size("embedding")).alias("dimensions"),
        )
    ok = embedded.where(F.col("embed_status") == "ok").drop("embed_status", "embed_error")
    return index.upsert(ok, unique=True)
