"""Chat events as lines of JSON (A8): one request body per line, ``{"event_id": 7, "event": {"type": ..., "text": ...}}``.

A line becomes a row of ``schemas.EVENTS`` with ``has_thread``, or a row for the quarantine with the reason why it can't be
read; no line is lost and none fails the stream.  Which keys an event has counts, as for the handlers: an
absent ``text`` is ``""``, a null one stays null (no reply); ``thread_ts`` names a thread if the key is there, also as
null.  Values that are no strings are read as their JSON text.  Blank lines are no events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore import schemas

FIELDS = [f.name for f in schemas.EVENTS.fields if f.name != "event_id"]
_BODY = f"event_id long, event struct<{', '.join(f'`{f}`:string' for f in FIELDS)}>, _bad string"
NOT_JSON, NO_EVENT, NO_ID = "not readable as JSON", "no event", "no event_id"


def parse_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """``EVENTS`` columns, ``has_thread``, ``line`` and ``reason`` (null for events that could be read)."""
    value = F.col(line)
    body = F.from_json(value, _BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys(F.get_json_object(value, "$.event"))
    rows = lines.where(F.length(F.trim(value)) > 0).select(value.alias("line"), body.alias("b"), keys.alias("keys"))
    reason = (F.when(F.col("b").isNull() | F.col("b._bad").isNotNull(), F.lit(NOT_JSON))
              .when(F.col("b.event").isNull(), F.lit(NO_EVENT)).when(F.col("b.event_id").isNull(), F.lit(NO_ID)))
    has = {k: F.coalesce(F.array_contains("keys", k), F.lit(False)) for k in ("text", "thread_ts")}
    fields = {f: F.col(f"b.event.{f}") for f in FIELDS}
    fields["text"] = F.when(has["text"], fields["text"]).otherwise(F.lit(""))
    return rows.select(F.col("b.event_id").alias("event_id"), *[c.alias(f) for f, c in fields.items()],
                       has["thread_ts"].alias("has_thread"), "line", reason.alias("reason"))


def readable(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("line", "reason")


def unreadable(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("line", "reason")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The events of a folder of JSON lines, and the lines that can't be read."""
    parsed = parse_events(spark.read.text(path))
    return readable(parsed), unreadable(parsed)


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The parsed lines of a folder as a stream; ``readable`` and ``unreadable`` part them."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_events(reader.text(path))
