"""Field extraction from landed model-service responses (JSON strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlore.functions.text import _col

EMBED_RESPONSE = "embedding ARRAY<DOUBLE>, error STRING"
CHAT_RESPONSE = "message STRUCT<role: STRING, content: STRING>, error STRING"


def embedding_of(body: Column | str) -> Column:
    """The ``embedding`` array of an embedding response, null when absent."""
    return F.from_json(_col(body), EMBED_RESPONSE).getField("embedding")


def chat_content(body: Column | str) -> Column:
    """``message.content`` of a chat response."""
    return F.from_json(_col(body), CHAT_RESPONSE).getField("message").getField("content")


def error_of(body: Column | str, status: Column | str) -> Column:
    """What a failed response (HTTP status of 400 or more) says: its ``error`` field, else the whole
    body; null for a response that did not fail."""
    said = F.get_json_object(_col(body), "$.error")
    return F.when(_col(status) >= 400, F.coalesce(said, _col(body)))
