"""Landed chat data: channel messages, thread replies, user directory (A1, A4, A5).

Messages are stored partitioned by ``channel_id`` and day, so that target selection
(A2) and incremental runs (J7) prune partitions at the scan.  Raw JSON landings keep the difference
between an absent key and an explicit null, which the message semantics need:
``thread_ts`` counts by key presence, a missing ``text`` is ``""``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore import schemas
from chatlore.functions.text import ts_order

#: Partitions named in a scan's filter; more are left to the join that follows.
MAX_PLACES = 1_000
NO_DAY, ELSEWHERE = "none", "elsewhere"
DAY = T.StructField("day", T.StringType(), True)


def _has_key(raw: F.Column, key: str) -> F.Column:
    return F.array_contains(F.json_object_keys(raw), key)


def parse_raw_messages(raw: DataFrame, channel_col: str = "channel_id", body_col: str = "body") -> DataFrame:
    """One JSON object per message (as the chat API returns it) -> MESSAGES + has_thread.

    ``pos`` must already be a column of ``raw`` (page order).  Absent ``text``
    becomes ``""``; an explicit null text stays null.
    """
    body = F.col(body_col)
    fields = F.from_json(body, "ts STRING, user STRING, text STRING, subtype STRING, thread_ts STRING")
    return raw.select(
        F.col(channel_col).alias("channel_id"),
        F.col("pos").cast("long").alias("pos"),
        fields.ts.alias("ts"),
        fields.user.alias("user"),
        F.when(_has_key(body, "text"), fields.text).otherwise(F.lit("")).alias("text"),
        fields.subtype.alias("subtype"),
        fields.thread_ts.alias("thread_ts"),
        _has_key(body, "thread_ts").alias("has_thread"),
    )


def with_has_thread(messages: DataFrame) -> DataFrame:
    """Tabular inputs cannot tell absent from null: a thread exists iff thread_ts is set."""
    if "has_thread" in messages.columns:
        return messages
    return messages.withColumn("has_thread", F.col("thread_ts").isNotNull())


def day_of(ts: F.Column | str) -> F.Column:
    """The number of the day of a message ts as a partition value."""
    return F.coalesce(F.floor(ts_order(ts) / 86_400).cast("string"), F.lit(NO_DAY))


def message_day() -> F.Column:
    """The landing partition of a message: the day of its ts, or ``ELSEWHERE`` if it names a thread that
    is not its own ts (such a message belongs to the thread's day as well)."""
    other = F.col("thread_ts").isNotNull() & ~F.col("thread_ts").eqNullSafe(F.col("ts"))
    return F.when(other, F.lit(ELSEWHERE)).otherwise(day_of("ts"))


def land_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Write messages partitioned by channel and day, so that later scans prune by target and by the
    threads that changed; key presence (``has_thread``) is part of the landing."""
    (with_has_thread(messages).withColumn("day", message_day())
     .write.mode(mode).partitionBy("channel_id", "day").parquet(path))


def land_replies(replies: DataFrame, path: str, mode: str = "append") -> None:
    """Write replies partitioned by channel and day of their thread."""
    replies.withColumn("day", day_of("thread_ts")).write.mode(mode).partitionBy("channel_id", "day").parquet(path)


def _landed(spark: SparkSession, path: str, schema: T.StructType, touched: DataFrame | None) -> DataFrame:
    """A landing, with or without day partitions; ``touched`` (``channel_id, key_ts``) narrows it to the
    partitions that can hold rows of those keys."""
    rows = spark.read.schema(T.StructType([*schema.fields, DAY])).parquet(path)
    if touched is None:
        return rows.drop("day")
    found = touched.select("channel_id", day_of("key_ts").alias("day")).distinct().limit(MAX_PLACES + 1).collect()
    if len(found) <= MAX_PLACES:     # beyond, the join that follows does all the work
        channels, days = {r.channel_id for r in found}, {r.day for r in found} | {ELSEWHERE}
        # a landing without partitions has no day
        rows = rows.where(F.col("channel_id").isin(sorted(channels)) & (F.col("day").isin(sorted(days)) | F.col("day").isNull()))
    return rows.drop("day")


def read_messages(spark: SparkSession, path: str, touched: DataFrame | None = None) -> DataFrame:
    """Landed messages; in landings without ``has_thread`` a thread exists iff ``thread_ts`` is set."""
    rows = _landed(spark, path, schemas.LANDED_MESSAGES, touched)
    return rows.withColumn("has_thread", F.coalesce("has_thread", F.col("thread_ts").isNotNull()))


def read_replies(spark: SparkSession, path: str, touched: DataFrame | None = None) -> DataFrame:
    return _landed(spark, path, schemas.REPLIES, touched)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """User directory; one row per id (a deterministic pick for repeated ids)."""
    users = spark.read.schema(schemas.USERS).parquet(path)
    return dedup_users(users)


def dedup_users(users: DataFrame) -> DataFrame:
    return users.groupBy("user_id").agg(F.min("real_name").alias("real_name"))


def read_export(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A chat-workspace export: ``<root>/<channel>/<day>.json``, each file a
    JSON array of message objects.  Returns ``(messages, replies)``:

    * messages: top-level messages (no ``thread_ts`` key, or the thread
      parent itself), with ``pos`` = page order (newest first) and
      ``has_thread`` by key presence;
    * replies: every message of a thread (the parent included), the input of
      the thread stitch.

    Files are read whole (one day of one channel each) and parsed by Spark's
    JSON functions; each message keeps its raw object so absent and null keys
    stay distinct.
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/*.json", wholetext=True)
    raw = files.select(
        F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+\.json$", 1).alias("channel_id"),
        F.explode(F.from_json("value", "array<string>")).alias("body"),
    )
    return export_tables(raw)


def export_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(messages, replies)`` out of the objects of an export (``channel_id, body``)."""
    parsed = parse_raw_messages(raw.withColumn("pos", F.lit(0)))
    ts = F.col("ts").cast("decimal(20,6)")
    top = parsed.where(~F.col("has_thread") | (F.col("thread_ts") == F.col("ts")))
    # page order of the history API: newest first
    top = top.withColumn("pos", (-ts * F.lit(1_000_000)).cast("long"))
    replies = parsed.where(F.col("has_thread") & F.col("thread_ts").isNotNull()).select(
        "channel_id", "thread_ts", "ts", "user", "text")
    return top, replies
