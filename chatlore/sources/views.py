"""Input views derived from the driver tables (FIXTURES.md section 2).

Every view reads a whole driver table and only derives attributes from it
(channel, ts, user, subtype ...); none drops rows that belong to it (``messages``
is the first turn of each conversation, ``replies`` all turns).  The same formulas are
written in SQL in ``chatlore.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.operators.parallel import spread

BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z, first conversation second


# tables whose rows drive the heavy stages; a scan of fewer partitions than
# cores (a small single-row-group file) is spread over the cores first
_WIDE = ("events", "documents", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in _WIDE else df


def _turn_ts(conv_id: F.Column, turn: F.Column) -> F.Column:
    return F.concat((F.lit(BASE_EPOCH) + conv_id).cast("string"), F.lit("."),
                    F.lpad(turn.cast("string"), 6, "0"))


def _conv_columns() -> dict[str, F.Column]:
    conv, turn = F.col("conv_id"), F.col("turn")
    return {
        "channel_id": F.concat(F.lit("C"), (conv % 4).cast("string")),
        "ts": _turn_ts(conv, turn),
        "user": F.when(conv % 7 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("U"), ((conv * 31 + turn) % 2000).cast("string"))),
        "subtype": F.when(F.col("role") == "system", F.lit("channel_join"))
        .when(conv % 10 == 3, F.lit("")).otherwise(F.lit(None).cast("string")),
        "thread_ts": F.when(conv % 5 == 0, F.lit(None).cast("string")).otherwise(_turn_ts(conv, F.lit(0))),
    }


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level channel messages: the first turn of every conversation.

    ``pos`` is the page order (newest first), i.e. descending conversation id.
    """
    c = _conv_columns()
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("turn") == 0)
        .select(
            c["channel_id"].alias("channel_id"),
            (-F.col("conv_id")).alias("pos"),
            c["ts"].alias("ts"),
            c["user"].alias("user"),
            F.col("text"),
            c["subtype"].alias("subtype"),
            c["thread_ts"].alias("thread_ts"),
        )
    )


def faulty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` as a landing by key presence, in which some have no ``ts``, a malformed one, or a
    null text (``conv_id`` divisible by 11, 13, 9)."""
    conv = -F.col("pos")
    ts = F.when(conv % 11 == 0, F.lit(None)).when(conv % 13 == 0, F.lit("")).otherwise(F.col("ts"))
    m = messages(spark, sf_dir).withColumn("has_thread", F.col("thread_ts").isNotNull())
    return m.withColumn("text", F.when(conv % 9 != 0, F.col("text"))).withColumn("ts", ts)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread replies: every turn, the parent (turn 0) first."""
    c = _conv_columns()
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        c["channel_id"].alias("channel_id"),
        _turn_ts(conv, F.lit(0)).alias("thread_ts"),
        c["ts"].alias("ts"),
        c["user"].alias("user"),
        F.col("text"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User directory from customers, every tenth of them listed twice (the second time under a name
    that sorts after the first); ids past the table stay unresolved."""
    once = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.col("c_name").alias("real_name"), (F.col("c_custkey") % 10 == 0).alias("twice"))
    names = F.when(F.col("twice"), F.array("real_name", F.concat("real_name", F.lit(" again")))).otherwise(F.array("real_name"))
    return once.select("user_id", F.explode(names).alias("real_name"))


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as channel messages: one channel per source, ts from doc_id."""
    d = F.col("doc_id")
    ts = F.concat((F.lit(BASE_EPOCH) + d).cast("string"), F.lit(".000000"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("channel_id"),
        (-d).alias("pos"),
        ts.alias("ts"),
        F.concat(F.lit("U"), (d % 2000).cast("string")).alias("user"),
        F.col("text"),
        F.lit(None).cast("string").alias("subtype"),
        F.lit(None).cast("string").alias("thread_ts"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-computed vectors as an index: ``id`` (long) and ``embedding``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _slack_ts(us: F.Column) -> F.Column:
    return F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."),
                    F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat events: clicks are mentions, views/purchases/signups are DMs, errors
    are channel messages the bot ignores.  Question text cycles through
    ``benchmark`` by event id."""
    ev = table(spark, sf_dir, "events")
    bench = table(spark, sf_dir, "benchmark")
    n_bench = bench.select(F.count("*")).scalar()
    # microseconds since the epoch of the wall-clock (NTZ) value: no session
    # time zone is involved
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    day_start = F.floor(us / 86_400_000_000) * 86_400
    etype = F.col("event_type")
    eid = F.col("event_id")
    base = ev.select(
        eid,
        F.when(etype == "click", F.lit("app_mention")).otherwise(F.lit("message")).alias("type"),
        F.when(etype == "click", F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")))
        .when(etype == "error", F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")))
        .otherwise(F.concat(F.lit("D"), F.col("user_id").cast("string"))).alias("channel"),
        F.when(etype.isin("view", "purchase", "signup"), F.lit("im"))
        .when(etype == "error", F.lit("channel")).otherwise(F.lit(None).cast("string")).alias("channel_type"),
        _slack_ts(us).alias("ts"),
        F.when(eid % 3 == 0, F.concat(day_start.cast("string"), F.lit(".000000")))
        .otherwise(F.lit(None).cast("string")).alias("thread_ts"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"),
        F.when(eid % 17 == 0, F.lit("B1")).otherwise(F.lit(None).cast("string")).alias("bot_id"),
        F.pmod(eid, n_bench).alias("item_id"),
        etype,
    )
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit(" <@U1> "), F.col("q")))
        .when(eid % 11 == 0, F.lit("Hello "))
        .otherwise(F.col("q"))
    )
    return (
        base.join(bench.select("item_id", F.col("text").alias("q")), "item_id", "left")
        .select("event_id", "type", "channel", "channel_type", "ts", "thread_ts", "user", "bot_id",
                text.alias("text"))
    )


def faulty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in which some have no user or no ts (``event_id`` divisible by 13, 19)."""
    eid = F.col("event_id")
    return (events(spark, sf_dir).withColumn("user", F.when(eid % 13 != 0, F.col("user")))
            .withColumn("ts", F.when(eid % 19 != 0, F.col("ts"))))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as lines of JSON without the keys that are null; every event whose id is divisible by 23 has
    a second line, which ends too early."""
    ev = events(spark, sf_dir)
    body = F.struct("event_id", F.struct(*[c for c in ev.columns if c != "event_id"]).alias("event"))
    whole = F.to_json(body).alias("value")
    lines = ev.select("event_id", whole)
    cut = lines.where(F.col("event_id") % 23 == 0).select(F.expr("left(value, length(value) - 3)").alias("value"))
    return lines.select("value").unionAll(cut)
