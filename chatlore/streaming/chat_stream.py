"""Chat turns as Structured Streaming.

Two chained queries, both restartable from their checkpoints:

1. ``turns``: the event stream (A8) -> routing, cleanup, small talk, keys ->
   ``foreachBatch``: retrieval and prompt/answer for the batch's distinct
   questions against the index snapshot current at that batch, appended as
   ``<work>/turns/batch=<id>``.  Instructions (contexts) and answers are long and repeat: they are
   appended once per distinct question to ``<work>/turns_texts``, and a turn names its texts by
   ``texts_key``, a digest of them, so a replay changes no text that a turn has named.
2. ``replies``: the turns stream -> ``applyInPandasWithState`` keyed by
   session: turns of a session in arrival order (then ts), memory appended
   after every success, greetings and failures leave it unchanged (J3).  A
   history-aware generator runs here, with the session's messages.  Replies are merged
   into ``<work>/replies`` by event id (A9), and name their text as the turns do unless it was
   made there; ``read_replies`` puts it in.

Every event is answered once without any rename or atomic folder operation.  A micro-batch of
turns that failed half-way is appended again whole, so the second query may see a turn twice; the
state of a session knows the newest batch and the event ids it has had of it, and leaves out what
it has seen (a batch is only begun after the one before is complete, so nothing older needs to be
known).  A micro-batch of replies replaces its own folder, which counts once its ``_SUCCESS`` is there.

Order (J5): arrival order is the order, as in the reference.  ``session_timeout`` (off by default, as
there) empties a session's memory when more than so many seconds lie between a turn and the one before
it.  Turns carry no event time of their own, so none is ever too late: a clock row per micro-batch moves the
watermark, and the event-time timers of expired sessions remove their state.

The replies query observes what it reads and writes (D5: turns, sizes of questions, instructions, history and
responses); ``record_metrics`` keeps the numbers of its finished micro-batches in ``<work>/metrics``.

Without a history-aware generator the state is a count; with one it is every message of the
session, like the reference's; ``max_messages`` bounds what the generator reads, not the count.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from chatlore import schemas
from chatlore.config import ERROR_REPLY, Params
from chatlore.functions.text import ts_order
from chatlore.operators import events as EV
from chatlore.operators import knn
from chatlore.operators.answer import given, on_requests
from chatlore.plans.chat import answer_distinct
from chatlore.plans.retrieve import question_key
from chatlore.session import materialize, scratch_path
from chatlore.sources import json_events

TURNS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("channel", T.StringType(), True),
    T.StructField("ts", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("session_key", T.StringType(), True),
    T.StructField("thread_ts", T.StringType(), True),
    T.StructField("query", T.StringType(), True),
    T.StructField("instruction", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
])

#: Of stored turns besides: the name and the sizes of texts that are kept apart (null where they are in the row), the clock.
STORED_TURNS = T.StructType([
    *TURNS.fields,
    T.StructField("texts_key", T.StringType(), True),
    T.StructField("instruction_chars", T.LongType(), True),
    T.StructField("answer_chars", T.LongType(), True),
    T.StructField("clock", T.TimestampType(), True),
    T.StructField("batch", T.LongType(), True),
])

TEXTS = T.StructType([
    T.StructField("texts_key", T.StringType(), True),
    T.StructField("instruction", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
])

REPLIES = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("channel", T.StringType(), True),
    T.StructField("thread_ts", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("session_key", T.StringType(), True),
    T.StructField("history_len", T.LongType(), True),
])

MADE_REPLIES = T.StructType([*REPLIES.fields, T.StructField("texts_key", T.StringType(), True), T.StructField("text_chars", T.LongType(), True)])

# messages are kept only for a generator that reads them; the count is always true
STATE = T.StructType([
    T.StructField("messages", T.ArrayType(schemas.CHAT_MESSAGE), True),
    T.StructField("n_messages", T.LongType(), True),
    T.StructField("batch", T.LongType(), True),                      # the newest turns batch
    T.StructField("seen", T.ArrayType(T.LongType()), True),          # its events so far
    T.StructField("last_seconds", T.DoubleType(), True),             # of the last turn, with a timeout only
])
METRICS = T.StructType([
    T.StructField("batch", T.LongType(), False), T.StructField("stage", T.StringType(), False),
    T.StructField("metric", T.StringType(), False), T.StructField("value", T.LongType(), False),
])
#: ``event_id`` of the row that only moves the watermark.
CLOCK = -(1 << 63)


def event_time() -> F.Column:
    return F.timestamp_micros((ts_order("ts") * 1_000_000).cast("long"))


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _texts_dir(turns_dir: str) -> str:
    return f"{turns_dir}_texts"


def _fits(rows: int, size: int | None) -> bool:
    """Whether so many texts of so many bytes may be broadcast."""
    return (size or 0) + rows * knn.HIT_BYTES <= knn.DEFAULT_BROADCAST_BYTES


def _turns_batch(index_reader, params: Params, embedder, generator, out_dir: str, quarantine_dir: str, instructions_in_turns: bool = False):
    """``instructions_in_turns``: for a replies query that runs already and can't look up what is written later."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if "reason" not in batch.columns:
            return answer(batch, batch_id)
        # lines of JSON, parsed once; a replay replaces what it put aside
        spark = batch.sparkSession
        parsed = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
        try:
            batch.withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line"))).write.parquet(parsed)
            batch = spark.read.schema(batch.schema).parquet(parsed)
            json_events.unreadable(batch).write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}")
            answer(json_events.readable(batch), batch_id)
        finally:
            fs, path = _fs(spark, parsed)
            fs.delete(path, True)

    def answer(batch: DataFrame, batch_id: int) -> None:
        prepared = EV.prepare(batch, params.small_talk, params.scope_by_channel)
        asks = prepared.where(~F.col("small_talk")).withColumn("qkey", question_key(F.col("query")))
        answered = answer_distinct(asks, index_reader(), params, embedder, generator).select("qkey", "instruction", "answer", "status")
        texts_key = F.sha2(F.to_json(F.struct("instruction", "answer"), {"ignoreNullFields": "false"}), 256)
        answered = materialize(answered.withColumns({"texts_key": texts_key, "instruction_chars": F.length("instruction").cast("long"),
                                                     "answer_chars": F.length("answer").cast("long")}))
        answered.select(*TEXTS.fieldNames()).write.mode("append").parquet(f"{_texts_dir(out_dir)}/batch={batch_id}")
        named = answered.select("qkey", "status", "texts_key", "instruction_chars", "answer_chars",
                                *(["instruction"] if instructions_in_turns else []))
        if not instructions_in_turns:
            named = named.withColumn("instruction", F.lit(None).cast("string"))
            if _fits(named.count(), 0):
                named = F.broadcast(named)
        turns = asks.join(named, "qkey", "left")
        turns = turns.select(
            "event_id", "channel", "ts", "kind", "session_key", F.col("reply_thread_ts").alias("thread_ts"),
            "query", "instruction", F.lit(None).cast("string").alias("answer"), F.coalesce("status", F.lit("error")).alias("status"),
            "texts_key", "instruction_chars", "answer_chars")
        greets = prepared.where(F.col("small_talk")).select(
            "event_id", "channel", "ts", "kind", "session_key", F.col("reply_thread_ts").alias("thread_ts"),
            "query", F.lit(None).cast("string").alias("instruction"),
            F.lit(params.greeting).alias("answer"), F.lit("greeting").alias("status"))
        publish(turns.unionByName(greets, allowMissingColumns=True), prepared, out_dir, batch_id)

    return run


def publish(turns: DataFrame, events: DataFrame, out_dir: str, batch_id: int) -> None:
    """Append a micro-batch's turns and the clock row of its events.  A replay appends them again.
    Turns hold their texts, or name them by ``texts_key``."""
    clock = (events.agg(F.max(event_time()).alias("clock")).where("clock IS NOT NULL")
             .select(F.lit(CLOCK).alias("event_id"), "clock"))
    # questions repeat, and with them contexts: a file holds each once while they fit its dictionary
    turns.unionByName(clock, allowMissingColumns=True).write.mode("append").option("parquet.dictionary.page.size", 16 << 20).parquet(f"{out_dir}/batch={batch_id}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _seconds(ts: str | None) -> float | None:
    """A ts as ``ts_order`` reads it."""
    try:
        return float(Decimal(ts)) if ts and Decimal(ts).is_finite() else None
    except InvalidOperation:
        return None


_TURN_COLUMNS = [*TURNS.fieldNames(), "texts_key", "answer_chars", "batch"]
_MADE = pd.Index(MADE_REPLIES.fieldNames())
_TS, _BATCH = _TURN_COLUMNS.index("ts"), _TURN_COLUMNS.index("batch")


def _plain(column: pd.Series) -> list:
    """Values of a column, ``None`` for missing ones, whole numbers as such."""
    if column.dtype.kind == "f":        # numbers with nulls; no column of turns holds fractions
        return [None if math.isnan(x) else int(x) for x in column.tolist()]
    return column.tolist()


def _length(text) -> int | None:
    return len(text) if isinstance(text, str) else None


def _memory(make_generator, max_messages: int | None, session_timeout: float | None = None, texts=None):
    """``texts``: a broadcast dict of the instructions that turns name by ``texts_key``."""
    def arm(state, last: float | None) -> None:
        if session_timeout is not None and last is not None:
            # never before the watermark, which a late turn can be behind of
            state.setTimeoutTimestamp(max(int((last + session_timeout) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    def step(key, batches: Iterator[pd.DataFrame], state):
        if session_timeout is not None and state.hasTimedOut:
            state.remove()
            return
        messages, count, batch, seen, last = ([*state.get] if state.exists else ([], 0, -1, [], None))
        messages = [] if messages is None else [{"role": m["role"], "content": m["content"]} for m in messages]
        seen = set(seen)
        gen = make_generator() if make_generator else None
        turns = [r for pdf in batches for r in zip(*(_plain(pdf[c]) for c in _TURN_COLUMNS)) if r[0] != CLOCK]
        if not turns:
            if state.exists:
                arm(state, last)     # a call clears the timer
            return
        # arrival order: the turns batch first, then ts inside a batch
        turns = [(_seconds(r[_TS]), r) for r in turns]
        turns.sort(key=lambda t: (t[1][_BATCH], t[0] is not None, t[0] or 0.0, t[1][0] is not None, t[1][0] or 0))
        rows = []
        for now, r in turns:
            event_id, channel, _, kind, session_key, thread_ts, query, instruction, answer, status, texts_key, chars, of_batch = r
            if of_batch < batch or (of_batch == batch and event_id in seen):
                continue                                  # of a micro-batch that was written again
            if of_batch > batch:
                batch, seen = int(of_batch), set()
            seen.add(event_id)
            if status == "greeting":
                rows.append((event_id, channel, thread_ts, answer, "greeting", kind, session_key, None, texts_key,
                             chars if texts_key else _length(answer)))
                continue
            if session_timeout is not None and now is not None:
                if last is not None and now - last > session_timeout:
                    messages, count = [], 0
                last = now if last is None else max(last, now)
            before = count
            if gen is not None and status == "ok":
                if texts is not None and texts_key is not None and instruction is None:
                    instruction = texts.value.get(texts_key)
                try:
                    answer = gen(given(messages, gen), instruction)
                except Exception:  # noqa: BLE001 - memory unchanged on failure
                    status = "error"
                texts_key = None
            if status == "ok":
                count += 2
                if gen is not None:
                    messages.append({"role": "user", "content": query})
                    messages.append({"role": "assistant", "content": answer})
                    messages = messages[-max_messages:] if max_messages else messages
            else:
                answer, texts_key = ERROR_REPLY, None
            rows.append((event_id, channel, thread_ts, answer if texts_key is None else None, status, kind, session_key, before,
                         texts_key, chars if texts_key else _length(answer)))
        state.update((messages, count, batch, sorted(seen), last))
        arm(state, last)
        if rows:
            made = np.empty((len(rows), len(MADE_REPLIES)), object)     # one block: sessions are many and mostly short
            made[:] = rows
            yield pd.DataFrame(made, columns=_MADE)

    return step


def start(spark: SparkSession, events_path: str, index_reader, work_dir: str, params: Params = Params(),
          embedder=None, generator=None, history_generator=None, max_messages: int | None = None,
          max_files_per_trigger: int | None = None, available_now: bool = True, session_timeout: float | None = None,
          late_seconds: int = 0, request_generator=None, events_format: str = "parquet"):
    """Start both queries; returns ``(turns_query, replies_query, replies_path)``.

    ``index_reader()`` returns the index DataFrame and is called per batch, so
    upserts between batches are seen by later questions.  ``session_timeout`` in seconds, ``None`` for
    none; the state of an expired session goes ``late_seconds`` later by event time.
    ``request_generator`` makes ``answer.RequestFn``, which gets each turn's model, messages and temperature.
    ``events_format``: ``parquet``, or ``json`` for lines of JSON; lines that can't be read are put aside (``read_quarantine``).
    """
    if request_generator is not None:
        history_generator = on_requests(request_generator, params)
    turns_dir = f"{work_dir}/turns"
    replies_dir = f"{work_dir}/replies"
    if events_format not in ("parquet", "json"):
        raise ValueError("events_format must be 'parquet' or 'json'")
    source = json_events.event_stream if events_format == "json" else event_stream
    events = source(spark, events_path, max_files_per_trigger)
    inside = history_generator is not None and not available_now
    w1 = (events.writeStream.foreachBatch(_turns_batch(index_reader, params, embedder, generator, turns_dir, f"{work_dir}/quarantine", inside))
          .option("checkpointLocation", f"{work_dir}/_chk_turns"))
    w1 = w1.trigger(availableNow=True) if available_now else w1
    q1 = w1.start()
    q1.awaitTermination() if available_now else None
    return q1, _start_replies(spark, turns_dir, replies_dir, work_dir, history_generator, max_messages,
                              available_now, session_timeout, late_seconds), replies_dir


def _start_replies(spark, turns_dir, replies_dir, work_dir, history_generator, max_messages, available_now,
                   session_timeout=None, late_seconds=0):
    fs, path = _fs(spark, turns_dir)
    fs.mkdirs(path)  # an event stream without any batch yet still has a turns folder
    turns = spark.readStream.schema(STORED_TURNS).option("maxFilesPerTrigger", 1000).parquet(turns_dir)
    turns = turns.observe("chat_turns", *_turn_metrics())
    shared = None
    if history_generator is None:   # the answers are there: contexts needn't go to the sessions
        turns = turns.withColumn("instruction", F.lit(None).cast("string"))
    else:
        known = _texts(spark, turns_dir).select("texts_key", "instruction")
        size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("instruction")).alias("b")).first()
        if _fits(size["n"], size["b"]):
            shared = spark.sparkContext.broadcast({r["texts_key"]: r["instruction"] for r in known.collect()})
        else:
            own = F.when(F.col("instruction").isNull(), F.coalesce("texts_key", _no_key("event_id")))
            known = known.select(F.col("texts_key").alias("_key"), F.col("instruction").alias("_instruction"))
            turns = (turns.withColumn("_own", own).join(known, F.col("_own") == F.col("_key"), "left")
                     .withColumn("instruction", F.coalesce("instruction", "_instruction")).drop("_own", "_key", "_instruction"))
    timeout = GroupStateTimeout.NoTimeout
    if session_timeout is None:
        turns = turns.where(F.col("event_id") != CLOCK).drop("clock")
    else:
        turns = turns.withWatermark("clock", f"{late_seconds} seconds")
        timeout = GroupStateTimeout.EventTimeTimeout
    replies = turns.groupBy("session_key").applyInPandasWithState(
        _memory(history_generator, max_messages, session_timeout, shared), MADE_REPLIES, STATE, "append", timeout)
    replies = replies.observe("chat_replies", *_reply_metrics())
    w2 = (replies.writeStream.foreachBatch(lambda batch, batch_id: merge_replies(batch, replies_dir, batch_id))
          .option("checkpointLocation", f"{work_dir}/_chk_replies").outputMode("append"))
    w2 = w2.trigger(availableNow=True) if available_now else w2
    q2 = w2.start()
    if available_now:
        q2.awaitTermination()
        record_metrics(q2, work_dir)
    return q2


def _total(value: F.Column, name: str) -> F.Column:
    return F.coalesce(F.sum(value.cast("long")), F.lit(0)).alias(name)


def _turn_metrics() -> list[F.Column]:
    instruction = F.coalesce("instruction_chars", F.length("instruction").cast("long"))
    return [_total(F.col("event_id") != CLOCK, "turns"), _total(F.length("query"), "query_chars"),
            _total(instruction, "instruction_chars"), F.max(instruction).alias("instruction_chars_max")]


def _reply_metrics() -> list[F.Column]:
    return [F.count(F.lit(1)).alias("replies"), _total(F.col("status") == "error", "errors"),
            _total(F.col("status") == "greeting", "greetings"), _total(F.col("history_len"), "history_messages"),
            F.max("history_len").alias("history_messages_max"), _total(F.col("text_chars"), "response_chars"),
            F.max("text_chars").alias("response_chars_max")]


def record_metrics(query, work_dir: str) -> None:
    """Append what a replies query observed to ``<work>/metrics``: of the micro-batches in its progress, which holds the last
    ``spark.sql.streaming.numRecentProgressUpdates``.  A query that runs on is recorded now and then; a batch may be
    recorded twice (``read_metrics`` counts it once).  Metrics without a value (no row had one) are left out."""
    rows = [(int(p.batchId), stage, metric, int(value)) for p in query.recentProgress for stage, seen in p.observedMetrics.items()
            for metric, value in seen.asDict().items() if value is not None]
    if rows:        # some numbers per micro-batch
        SparkSession.active().createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(f"{work_dir}/metrics")


def read_metrics(spark: SparkSession, work_dir: str) -> DataFrame:
    """``batch, stage, metric, value``, once per micro-batch.  A turn that a replay appended again
    is read, and counted in ``chat_turns``, again; its reply is one."""
    fs, path = _fs(spark, f"{work_dir}/metrics")
    if not fs.exists(path):
        return spark.createDataFrame([], METRICS)
    rows = spark.read.schema(METRICS).parquet(f"{work_dir}/metrics")
    return rows.groupBy("batch", "stage", "metric").agg(F.max("value").alias("value"))


def run_totals(metrics: DataFrame) -> DataFrame:
    """``metric, value`` over all micro-batches: the greatest of ``_max`` metrics, the sum of the others."""
    value = F.when(F.col("metric").endswith("_max"), F.max("value")).otherwise(F.sum("value"))
    return metrics.groupBy("metric").agg(value.alias("value"))


def merge_replies(replies: DataFrame, replies_dir: str, batch_id: int) -> None:
    """A micro-batch's replies, in a folder of its own that a replay replaces whole."""
    replies.drop("text_chars").write.mode("overwrite").parquet(f"{replies_dir}/batch={batch_id}")


def read_replies(spark: SparkSession, replies_dir: str) -> DataFrame:
    """One reply per event id, the earliest; of micro-batches whose write is complete."""
    fs, path = _fs(spark, replies_dir)
    folders = [st.getPath() for st in fs.listStatus(path)] if fs.exists(path) else []
    done = [f"{replies_dir}/{f.getName()}" for f in folders
            if f.getName().startswith("batch=") and fs.exists(f.suffix("/_SUCCESS"))]
    if not done:  # no micro-batch has committed yet
        return spark.createDataFrame([], REPLIES)
    stored = T.StructType([*REPLIES.fields, T.StructField("texts_key", T.StringType(), True), T.StructField("batch", T.LongType(), True)])
    rows = spark.read.schema(stored).option("basePath", replies_dir).parquet(*done)
    rest = [c for c in stored.fieldNames() if c not in ("event_id", "batch")]
    first = rows.groupBy("event_id").agg(F.min_by(F.struct(*rest), "batch").alias("r")).select("event_id", "r.*")
    known = _texts(spark, f"{replies_dir.rstrip('/').rpartition('/')[0]}/turns").select(F.col("texts_key").alias("_key"), F.col("answer").alias("_answer"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_answer")).alias("b")).first()
    if not size["n"]:
        return first.select(*REPLIES.fieldNames())
    if _fits(size["n"], size["b"]):
        known = F.broadcast(known)
    whole = first.withColumn("_own", F.coalesce("texts_key", _no_key("event_id"))).join(known, F.col("_own") == F.col("_key"), "left")
    return whole.withColumn("text", F.coalesce("text", "_answer")).select(*REPLIES.fieldNames())


def _no_key(column: str) -> F.Column:
    """A key that no text has, one for each row, so that rows without texts don't meet in one partition."""
    return F.concat(F.lit("-"), F.coalesce(F.col(column).cast("string"), F.lit("")))


def _texts(spark: SparkSession, turns_dir: str) -> DataFrame:
    """``TEXTS`` that turns name, each once.  Those of a micro-batch that failed half-way may be there; no turn names them."""
    fs, path = _fs(spark, _texts_dir(turns_dir))
    if not fs.exists(path):
        return spark.createDataFrame([], TEXTS)
    return spark.read.schema(TEXTS).parquet(_texts_dir(turns_dir)).select(*TEXTS.fieldNames()).dropDuplicates(["texts_key"])


def read_quarantine(spark: SparkSession, work_dir: str) -> DataFrame:
    """``line, reason, batch`` of the JSON lines that couldn't be read, by micro-batch; of complete writes only."""
    fs, path = _fs(spark, f"{work_dir}/quarantine")
    folders = [st.getPath() for st in fs.listStatus(path)] if fs.exists(path) else []
    done = [f"{work_dir}/quarantine/{f.getName()}" for f in folders if fs.exists(f.suffix("/_SUCCESS"))]
    schema = T.StructType([T.StructField("line", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("batch", T.LongType())])
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{work_dir}/quarantine").parquet(*done)
