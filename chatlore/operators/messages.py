"""Channel-message operators: targets (A2), page cap (A3/E1), system filter (B1),
projection defaults (B2) and load errors (G5)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlore.functions.text import falsy, ts_order


def select_targets(messages: DataFrame, targets: Iterable[str] | DataFrame | None) -> DataFrame:
    """Keep the configured channels in one job (no per-channel loop).

    A short list becomes an ``IN`` filter that reaches the scan (partition
    pruning on a channel-partitioned landing); a target table becomes a left
    semi join, which AQE broadcasts when its measured size is small.
    """
    if targets is None:
        return messages
    if isinstance(targets, DataFrame):
        return messages.join(targets.select("channel_id").distinct(), "channel_id", "left_semi")
    return messages.where(F.col("channel_id").isin(list(targets)))


def recent_cap(messages: DataFrame, cap: int | None) -> DataFrame:
    """The newest ``cap`` messages of each channel, counted before any filter.

    ``row_number() <= cap`` plans as WindowGroupLimit: every map task keeps at
    most ``cap`` rows per channel before the shuffle, so a channel holding a
    third of all rows sends only ``cap`` rows per task across the network.
    """
    if cap is None:
        return messages
    w = Window.partitionBy("channel_id").orderBy(ts_order("ts").desc_nulls_last(), F.col("pos"))
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def drop_system(messages: DataFrame) -> DataFrame:
    """Skip messages whose subtype is truthy; null and empty subtypes are kept."""
    return messages.where(falsy("subtype"))


def project(messages: DataFrame) -> DataFrame:
    """Defaults of the message projection: a missing text is ``""``."""
    return messages.withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def failure(messages: DataFrame) -> F.Column:
    """Why a message cannot be loaded, null if it can: without a numeric ``ts`` it has no link and no
    place; replies cannot be added to a null text.  Only landings that tell absent from null
    (``has_thread`` by key) hold null texts, an absent one is empty there."""
    reason = F.when(F.col("ts").isNull(), "missing ts").when(ts_order("ts").isNull(), "malformed ts")
    if "has_thread" in messages.columns:
        reason = reason.when(F.col("has_thread") & F.col("text").isNull(), "null text in a thread")
    return reason


def bad_message(messages: DataFrame) -> F.Column:
    return failure(messages).isNotNull()


def load_errors(messages: DataFrame) -> DataFrame:
    """Messages that make the load fail, with a reason; pass what the loader reaches (targets, cap and
    system filter applied: ``documents.reached``)."""
    return messages.where(bad_message(messages)).select(
        "channel_id", "pos", "user", failure(messages).alias("reason"))


def truncate_at_error(messages: DataFrame) -> DataFrame:
    """Reference behaviour on a failing message: keep the documents built before
    it in page order, drop it and everything after it, per channel.

    The first failing position per channel is a partial aggregate (one row per
    channel), joined back on the channel.
    """
    first_bad = (
        messages.where(bad_message(messages))
        .groupBy("channel_id").agg(F.min("pos").alias("_first_bad"))
    )
    return (
        messages.join(first_bad, "channel_id", "left")
        .where(F.col("_first_bad").isNull() | (F.col("pos") < F.col("_first_bad")))
        .drop("_first_bad")
    )


def skip_errors(messages: DataFrame) -> DataFrame:
    """Default: bad rows go to ``load_errors``; every good row is kept."""
    return messages.where(~bad_message(messages))
