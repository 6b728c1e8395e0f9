"""Scalar Column functions."""

from chatlore.functions.keys import dm_key, mention_key
from chatlore.functions.prompt import chat_message, instruction, prompt, source_header
from chatlore.functions.responses import chat_content, embedding_of, error_of
from chatlore.functions.text import (
    author_name,
    doc_id,
    falsy,
    is_small_talk,
    mention_strip,
    permalink,
    py_strip,
    reply_line,
    ts_digits,
    ts_order,
)
from chatlore.functions.vectors import dimension, distance, dot, l2sq, norm

__all__ = [
    "author_name", "chat_content", "chat_message", "dimension", "distance", "dm_key",
    "doc_id", "dot", "embedding_of", "error_of", "falsy", "instruction", "is_small_talk",
    "l2sq", "mention_key", "mention_strip", "norm", "permalink", "prompt", "py_strip",
    "reply_line", "source_header", "ts_digits", "ts_order",
]
