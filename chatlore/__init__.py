"""chatlore: retrieval over team conversations, as Spark jobs.

Channel messages, thread replies and a user directory become one document per
thread; documents are embedded, kept in an upsertable Parquet vector index and
searched with exact or approximate top-k joins; questions get cited context,
prompts and answers, with per-session memory in batch and in Structured
Streaming.
"""

__version__ = "0.1.0"
