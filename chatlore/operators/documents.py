"""Thread documents: id, permalink, metadata (H1-H4, B4) and the whole loader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.config import Params
from chatlore.functions.text import doc_id, permalink
from chatlore.operators import authors, messages as msg, stitch
from chatlore.sources.chat import with_has_thread


def reached(messages: DataFrame, params: Params) -> DataFrame:
    """The messages the loader looks at: target channels -> newest ``cap`` per channel -> no system messages."""
    m = msg.select_targets(messages, params.targets)
    return msg.drop_system(msg.recent_cap(m, params.history_cap))


def kept_parents(messages: DataFrame, params: Params, on_error: str = "skip") -> DataFrame:
    """The reached messages after the error policy, with ``has_thread`` and without null texts."""
    m = reached(messages, params)
    if on_error == "truncate":
        m = msg.truncate_at_error(m)
    elif on_error == "skip":
        m = msg.skip_errors(m)
    else:
        raise ValueError("on_error must be 'skip' or 'truncate'")
    return msg.project(with_has_thread(m))


def load_documents(
    messages: DataFrame,
    replies: DataFrame | None,
    users: DataFrame,
    params: Params = Params(),
    on_error: str = "skip",
    bucket_seconds: int | tuple[int, ...] = (60, 86_400),
) -> DataFrame:
    """One document per kept top-level message: ``id, text, metadata, pos``.

    One DAG for all channels: cap and filters on messages, the replies of kept
    threads only, name lookups as joins, stitch as two partial aggregates.
    """
    parents = kept_parents(messages, params, on_error)
    if replies is None:  # no thread replies at all: the documents are the messages
        with_threads = authors.resolve(parents, users, "user", "author").withColumn(
            "replies_text", F.lit(None).cast("string"))
    else:
        thread_rows = stitch.cap_replies(stitch.thread_replies(replies, parents), params.reply_cap)
        named = authors.resolve(thread_rows, users, "user", "name")
        stitched = stitch.stitch(named, "name", bucket_seconds)
        parents = authors.resolve(parents, users, "user", "author")
        with_threads = parents.join(stitched, stitch.THREAD_KEY, "left")
    text = F.when(
        F.col("has_thread"), F.concat(F.col("text"), F.coalesce(F.col("replies_text"), F.lit("")))
    ).otherwise(F.col("text"))
    return with_threads.select(
        doc_id("channel_id", "ts").alias("id"),
        text.alias("text"),
        F.struct(
            F.col("author").alias("author"),
            permalink("channel_id", "ts", params.domain).alias("slack_url"),
            F.col("channel_id").alias("channel_id"),
            F.col("ts").alias("timestamp"),
        ).alias("metadata"),
        F.col("pos"),
    )


def flatten(docs: DataFrame) -> DataFrame:
    """Documents with the metadata struct as columns (for SQL comparison)."""
    return docs.select(
        "id", "text",
        F.col("metadata.author").alias("author"),
        F.col("metadata.slack_url").alias("slack_url"),
        F.col("metadata.channel_id").alias("channel_id"),
        F.col("metadata.timestamp").alias("timestamp"),
    )
