"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()

MESSAGES = T.StructType([
    T.StructField("channel_id", S, False),
    T.StructField("pos", L, True),          # fetch order in the channel page, newest first
    T.StructField("ts", S, True),
    T.StructField("user", S, True),
    T.StructField("text", S, True),
    T.StructField("subtype", S, True),
    T.StructField("thread_ts", S, True),
])

# a landing that tells an absent ``thread_ts`` from a null one
LANDED_MESSAGES = T.StructType([*MESSAGES.fields, T.StructField("has_thread", T.BooleanType(), False)])

REPLIES = T.StructType([
    T.StructField("channel_id", S, False),
    T.StructField("thread_ts", S, False),
    T.StructField("ts", S, True),
    T.StructField("user", S, True),
    T.StructField("text", S, True),
])

USERS = T.StructType([
    T.StructField("user_id", S, False),
    T.StructField("real_name", S, True),
])

METADATA = T.StructType([
    T.StructField("author", S, True),
    T.StructField("slack_url", S, True),
    T.StructField("channel_id", S, True),
    T.StructField("timestamp", S, True),
])

EMBEDDING = T.ArrayType(T.FloatType(), containsNull=True)

DOCUMENTS = T.StructType([
    T.StructField("id", S, False),
    T.StructField("text", S, True),
    T.StructField("metadata", METADATA, True),
    T.StructField("embedding", EMBEDDING, True),
])

EVENTS = T.StructType([
    T.StructField("event_id", L, False),
    T.StructField("type", S, True),
    T.StructField("channel", S, True),
    T.StructField("channel_type", S, True),
    T.StructField("ts", S, True),
    T.StructField("thread_ts", S, True),
    T.StructField("user", S, True),
    T.StructField("bot_id", S, True),
    T.StructField("text", S, True),
])

CHAT_MESSAGE = T.StructType([
    T.StructField("role", S, False),
    T.StructField("content", S, True),
])
