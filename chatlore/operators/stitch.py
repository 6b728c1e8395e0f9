"""Ordered thread stitch.

A thread's document text is the parent text followed by one line per reply,
in reply order, skipping the first element of the reply list (the parent).

The ordered concatenation is hierarchical so that a hot thread is never
sorted in a single task:

1. rows are grouped by ``(channel, thread, minute)``; each group sorts its own
   lines and keeps its first line apart;
2. minute pieces are merged per ``(channel, thread, day)`` in minute order,
   then day pieces per thread in day order.  The very first line of the
   thread (the parent) is the first line of the first piece and is dropped.

Every level is a hash aggregate with map-side partial aggregation; buckets
are monotone in ``ts`` so bucket order is reply order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlore.functions.text import reply_line, ts_order

THREAD_KEY = ["channel_id", "thread_ts"]


def thread_replies(replies: DataFrame, parents: DataFrame) -> DataFrame:
    """Only the replies of threads whose parent survived the cap and filters.

    The parent keys are at most ``cap x channels`` rows when a cap is set, so
    this semi join cuts the largest input before any other work.
    """
    keys = parents.where(F.col("has_thread")).select(*THREAD_KEY)
    return replies.join(keys, THREAD_KEY, "left_semi")


def cap_replies(replies: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` elements of each thread by ts (one page, parent
    first); ``row_number() <= cap`` plans as WindowGroupLimit, so a huge
    thread ships at most ``cap`` rows per map task."""
    if cap is None:
        return replies
    w = Window.partitionBy(*THREAD_KEY).orderBy(ts_order("ts"), F.col("ts"))
    return replies.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def stitch(replies: DataFrame, name_col: str = "name",
           bucket_seconds: int | tuple[int, ...] = (60, 86_400)) -> DataFrame:
    """``(channel_id, thread_ts, ts, <name_col>, text)`` -> ``(channel_id, thread_ts, replies_text)``.

    ``replies_text`` is ``""`` for a thread holding only its parent.

    ``bucket_seconds`` are the widths of the levels, each a multiple of the
    one before: lines are sorted inside ``(thread, minute)`` groups, minute
    pieces are merged inside ``(thread, day)`` groups (at most 1,440 pieces),
    then day pieces per thread.  Every group is bounded by the replies of one
    minute or by a fixed fan-in, however hot the thread.
    """
    widths = (bucket_seconds,) if isinstance(bucket_seconds, int) else tuple(bucket_seconds)
    order = ts_order("ts")
    lines = replies.select(
        *THREAD_KEY,
        F.floor(order / widths[0]).alias("_b"),
        F.struct(order.alias("o"), reply_line(name_col, "text").alias("line")).alias("_item"),
    )
    # level 0: sort the lines of one (thread, bucket); keep the first line apart
    pieces = (
        lines.groupBy(*THREAD_KEY, "_b")
        .agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        .select(
            *THREAD_KEY,
            "_b",
            F.element_at("_items", 1).getField("line").alias("_first"),
            F.array_join(
                F.transform(F.slice("_items", 2, F.size("_items")), lambda x: x.getField("line")), ""
            ).alias("_rest"),
        )
    )
    # coarser levels: merge the pieces of one (thread, wider bucket) in order
    for narrow, wide in zip(widths, widths[1:]):
        if wide % narrow:
            raise ValueError("each bucket width must be a multiple of the previous one")
        grouped = (pieces.withColumn("_up", F.floor(F.col("_b") / (wide // narrow)))
                   .groupBy(*THREAD_KEY, "_up")
                   .agg(F.array_sort(F.collect_list(F.struct("_b", "_first", "_rest"))).alias("_p")))
        pieces = grouped.select(*THREAD_KEY, F.col("_up").alias("_b"), *_merged("_p"))
    # last level: the pieces of the whole thread; drop its very first line (the parent)
    chunks = pieces.groupBy(*THREAD_KEY).agg(
        F.array_sort(F.collect_list(F.struct("_b", "_first", "_rest"))).alias("_chunks"))
    return chunks.select(*THREAD_KEY, _merged("_chunks")[1].alias("replies_text"))


def _merged(col: str) -> tuple[F.Column, F.Column]:
    """(first line, the rest) of ordered pieces, as the next level's piece."""
    head = F.element_at(col, 1)
    tail = F.array_join(
        F.transform(F.slice(col, 2, F.size(col)), lambda c: F.concat(c.getField("_first"), c.getField("_rest"))),
        "",
    )
    return head.getField("_first").alias("_first"), F.concat(head.getField("_rest"), tail).alias("_rest")
