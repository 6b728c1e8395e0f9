"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables (through ``chatlore.sources.views``);
its DuckDB twin with the same output columns is in ``chatlore.oracle_queries``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.config import Params
from chatlore.functions.responses import chat_content, embedding_of, error_of
from chatlore.functions.text import ts_order
from chatlore.operators import authors, documents, ivf, knn, stitch
from chatlore.operators import context as CTX
from chatlore.operators import embed as E
from chatlore.operators import events as EV
from chatlore.operators import history as H
from chatlore.operators import messages as msg
from chatlore.plans import chat as P_chat, ingest as P_ingest, retrieve as P_retrieve
from chatlore.session import materialize, scratch_path
from chatlore.sources import chat, views
from chatlore.sources.export_source import read_export_days, write_export
from chatlore.sources.hash_store import HashStore
from chatlore.sources.list_store import ListStore
from chatlore.sources.vector_index import VectorIndex
from chatlore.streaming import chat_stream as S_chat, ingest_stream as S_ingest

TARGETS = ("C0", "C2")
RECALL = Params(model="recall", temperature=0.25)


def message_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = chat.with_has_thread(views.messages(spark, sf))
    m = msg.project(msg.drop_system(msg.select_targets(m, TARGETS)))
    return m.select("channel_id", "ts", "user", "text", "subtype", "thread_ts")


def channel_recent_cap(spark: SparkSession, sf: str) -> DataFrame:
    capped = msg.recent_cap(views.document_messages(spark, sf), 20)
    return capped.select("channel_id", "ts", "pos", "user")


def cap_before_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = msg.drop_system(msg.recent_cap(views.messages(spark, sf), 10))
    return m.select("channel_id", "ts", "subtype")


def thread_stitch(spark: SparkSession, sf: str) -> DataFrame:
    parents = documents.kept_parents(views.messages(spark, sf), Params(history_cap=None))
    rows = stitch.thread_replies(views.replies(spark, sf), parents)
    named = authors.resolve(rows, views.users(spark, sf), "user", "name")
    return stitch.stitch(named)


def author_resolve(spark: SparkSession, sf: str) -> DataFrame:
    named = authors.resolve(views.replies(spark, sf), views.users(spark, sf), "user", "name")
    return named.select("channel_id", "ts", "user", "name")


def build_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents.load_documents(views.messages(spark, sf), views.replies(spark, sf),
                                    views.users(spark, sf), Params())
    return documents.flatten(docs)


def load_errors(spark: SparkSession, sf: str) -> DataFrame:
    return msg.load_errors(documents.reached(views.faulty_messages(spark, sf), Params()))


def load_truncate(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents.load_documents(views.faulty_messages(spark, sf), views.replies(spark, sf),
                                    views.users(spark, sf), Params(), on_error="truncate")
    return documents.flatten(docs)


def _index_docs(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as index rows: string id, text, metadata (channel = source)."""
    d = views.table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text"),
        F.struct(
            F.lit(None).cast("string").alias("author"),
            F.lit(None).cast("string").alias("slack_url"),
            F.col("source").alias("channel_id"),
            F.concat((F.lit(views.BASE_EPOCH) + F.col("doc_id")).cast("string"), F.lit(".000000"))
            .alias("timestamp"),
        ).alias("metadata"),
        F.col("lang"),
    )


def _fresh_index(spark: SparkSession, name: str) -> VectorIndex:
    return VectorIndex(spark, scratch_path(spark, f"index-{name}-{uuid.uuid4().hex}"))


def _emb_sum(c: str = "embedding") -> F.Column:
    return F.aggregate(F.col(c), F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))


def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    return E.embed(docs, "text").select("doc_id", "embedding")


def embed_documents_sql(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    return E.hash_embed_sql(docs, "doc_id", "text", 64)


class _FailsOnSome:
    """The hash embedder, down for texts whose length is divisible by 7."""

    def __init__(self):
        self.embed = E.HashEmbedder()

    def __call__(self, texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("model down")
        return self.embed(texts)


def embed_errors(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    out = E.embed(docs, "text", _FailsOnSome)
    return out.select("doc_id", "embed_status", "embed_error",
                      F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"))


def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Run 1 indexes the English and French documents; run 2 re-ingests the
    labelled documents with edited text (updates some ids, inserts others),
    every fourth twice in the batch (the newer one stays); run 3 adds the rest."""
    docs = _index_docs(spark, sf)
    labels = views.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    index = _fresh_index(spark, "upsert")
    run1 = docs.where(F.col("lang").isin("en", "fr")).drop("lang")
    run2 = (docs.join(labels, "id", "left_semi").drop("lang")
            .withColumn("text", F.concat(F.lit("v2 "), F.col("text"))))
    older = (run2.where(F.col("id").cast("long") % 4 == 0).withColumn("text", F.concat(F.lit("old "), F.col("text")))
             .withColumn("metadata", F.col("metadata").withField("timestamp", F.lit("1.000000"))))
    run3 = docs.where(~F.col("lang").isin("en", "fr") | F.col("lang").isNull()).join(labels, "id", "left_anti").drop("lang")
    for run in (run1, run2.unionByName(older), run3):
        index.upsert(P_ingest.embedded_documents(run).drop("embed_status", "embed_error"))
    snap = index.read()
    return snap.select("id", "text", F.col("metadata.channel_id").alias("channel_id"),
                       _emb_sum().alias("emb_sum"))


def index_upsert_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch twice, then an empty batch: rows unchanged, two versions."""
    docs = _index_docs(spark, sf).drop("lang")
    index = _fresh_index(spark, "idem")
    batch = P_ingest.embedded_documents(docs).drop("embed_status", "embed_error")
    index.upsert(batch)
    index.upsert(batch)
    index.upsert(batch.limit(0))
    versions = len(index.versions())
    return index.read().select("id", "text", F.lit(versions).alias("versions"))


def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    index = _fresh_index(spark, "ingest")
    P_ingest.ingest(views.messages(spark, sf), views.replies(spark, sf), views.users(spark, sf), index)
    snap = documents.flatten(index.read())
    return snap.join(index.read().select("id", _emb_sum().alias("n_tokens")), "id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector of ``embeddings`` searches the whole set: exact top-5, l2sq."""
    vecs = views.vectors(spark, sf)
    hits = knn.topk(vecs.withColumnRenamed("id", "question_id"), vecs, k=5, metric="l2sq")
    return _rounded(hits)


def retrieve_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    vecs = views.vectors(spark, sf)
    hits = knn.topk(vecs.withColumnRenamed("id", "question_id"), vecs, k=5, metric="cosine")
    return _rounded(hits)


def retrieve_topk_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Top-5 through inverted lists over k-means centroids: same inputs and rows as ``retrieve_topk``."""
    vecs = views.vectors(spark, sf)
    hits = ivf.topk_ivf(vecs.withColumnRenamed("id", "question_id"), vecs, k=5, n_lists=16)
    return _rounded(hits)


def retrieve_topk_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Top-5 out of stored inverted lists: built once, then opened anew and searched without training; same
    inputs and rows as ``retrieve_topk``."""
    path = scratch_path(spark, f"lists-{uuid.uuid4().hex}")
    vecs = views.vectors(spark, sf)
    ListStore(spark, path).build(vecs)
    return _rounded(ListStore(spark, path).topk(vecs.withColumnRenamed("id", "question_id"), k=5))


def retrieve_topk_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """The inputs of ``retrieve_topk`` through stored hash buckets: per question the rows found and the nearest one's
    distance, and whether the share of the exact search's rows among them is 0.9 or more over all questions."""
    path = scratch_path(spark, f"hashes-{uuid.uuid4().hex}")
    vecs = views.vectors(spark, sf)
    HashStore(spark, path).build(vecs)
    questions = vecs.withColumnRenamed("id", "question_id")
    found = materialize(HashStore(spark, path).topk(questions, k=5))
    recall = ivf.recall_at_k(found, materialize(knn.topk(questions, vecs, k=5)))
    return _rounded(found).groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("n_found"), F.min("distance").alias("nearest"),
                                                      F.lit(recall >= 0.9).alias("recall_reached"))


def retrieve_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of ``embeddings`` indexed with the text of the document of the
    same id; the ranking reads vectors only, text is joined to the winners."""
    vecs = views.vectors(spark, sf)
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    index = vecs.join(docs, "id", "inner")
    hits = knn.topk(vecs.withColumnRenamed("id", "question_id"), index.select("id", "embedding"), k=5)
    n_questions = vecs.count()
    out = knn.with_payload(hits, index, payload=("text", "source"), max_rows=n_questions * 5)
    return _rounded(out)


def retrieve_questions(spark: SparkSession, sf: str) -> DataFrame:
    """``benchmark`` questions against the hash-embedded ``documents``: top-5."""
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    index = E.embed(docs, "text").select("id", "embedding")
    hits = P_retrieve.search(views.questions(spark, sf), index, Params(), payload=False)
    return _rounded(hits)


def export_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level messages of an export, read through the data source by channel and day."""
    root = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    write_export(chat.with_has_thread(views.messages(spark, sf)), root)
    top, _ = read_export_days(spark, root)
    return top.select("channel_id", "ts", "user", "text", "subtype", "thread_ts", "has_thread")


def _doc_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index for the chat queries: every ``documents`` row as a channel
    message (channel = source), author resolved, hash-embedded."""
    index = P_chat.document_index(views.document_messages(spark, sf), views.users(spark, sf),
                                  Params(history_cap=None))
    # read twice (vectors for the search, text for the winners): materialise
    # once in the shared checkpoint folder, like a persisted index snapshot
    return materialize(index)


def _answered_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    qs = views.questions(spark, sf).withColumnRenamed("text", "query")
    ans = P_chat.answer_distinct(qs, _doc_index(spark, sf), Params())
    return qs.withColumn("qkey", P_retrieve.question_key(F.col("query"))).join(ans.drop("query"), "qkey")


def event_route(spark: SparkSession, sf: str) -> DataFrame:
    return EV.route(views.events(spark, sf)).select("event_id", "kind")


def mention_strip(spark: SparkSession, sf: str) -> DataFrame:
    return EV.prepare(views.events(spark, sf)).select("event_id", "kind", "query")


def small_talk(spark: SparkSession, sf: str) -> DataFrame:
    return EV.prepare(views.events(spark, sf)).select("event_id", "small_talk")


def session_key_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Session keys with memory per channel, and how many questions share each."""
    events = EV.prepare(views.events(spark, sf), scope_by_channel=True)
    return events.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


def session_key(spark: SparkSession, sf: str) -> DataFrame:
    return EV.prepare(views.events(spark, sf)).select("event_id", "session_key", "reply_thread_ts")


class _Echo:
    """A generator that names the question, down for questions whose length is divisible by 3."""

    def __call__(self, frame):
        questions = [p.rsplit("User Query: ", 1)[1] for p in frame["prompt"]]
        if any(len(q) % 3 == 0 for q in questions):
            raise RuntimeError("model down")
        return [f"answer to: {q}" for q in questions]


def _failing_chat(spark: SparkSession, sf: str) -> DataFrame:
    return P_chat.chat_batch(views.faulty_events(spark, sf), _doc_index(spark, sf), Params(), _FailsOnSome, _Echo)


def chat_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Events without user or ts, questions that can't be embedded and a generator that fails on some:
    every event is answered, failures by the error reply and without a trace in the memory."""
    return _failing_chat(spark, sf).select("event_id", "session_key", "text", "status", "history_len")


def session_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The message list a history-aware generator gets: the session's successful turns, then the question."""
    events = EV.prepare(views.faulty_events(spark, sf)).where(~F.col("small_talk"))
    turns = (events.select("event_id", "ts", "query").join(_failing_chat(spark, sf)
             .select("event_id", "session_key", F.col("text").alias("answer"), "status"), "event_id"))
    listed = CTX.message_list(H.history_messages(turns, F.col("status") == "ok").withColumn("instruction", F.col("query")))
    lines = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return listed.select("event_id", F.size("messages").alias("n_messages"), F.md5(F.array_join(lines, "\n")).alias("messages_md5"))


def session_history(spark: SparkSession, sf: str) -> DataFrame:
    replies = P_chat.chat_batch(views.events(spark, sf), _doc_index(spark, sf), Params())
    return replies.where(F.col("status") != "greeting").select("event_id", "session_key", "history_len")


def context_block(spark: SparkSession, sf: str) -> DataFrame:
    return _answered_benchmark(spark, sf).select("question_id", "context", "bare_context", "n_docs")


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    df = CTX.message_list(_answered_benchmark(spark, sf).withColumn("history", F.lit(None)))
    return df.select("question_id", "prompt", "instruction", F.size("messages").alias("n_messages"))


def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _answered_benchmark(spark, sf).select("question_id", "answer", "status")


def reply_route(spark: SparkSession, sf: str) -> DataFrame:
    replies = P_chat.chat_batch(views.events(spark, sf), _doc_index(spark, sf), Params())
    return replies.select("event_id", "channel", "thread_ts", "status", "kind")


def chat_batch(spark: SparkSession, sf: str) -> DataFrame:
    replies = P_chat.chat_batch(views.events(spark, sf), _doc_index(spark, sf), Params())
    return replies.select("event_id", "channel", "thread_ts", "text", "status", "history_len")


class _Recalls:
    """A chat model stand-in whose answer hangs on its whole request: the model, the temperature, the number
    of messages, its own last answer and the question; down for questions whose length is divisible by 3."""

    takes_view = True

    def __call__(self, request):
        messages = request["messages"]
        question = messages[-1]["content"].rsplit("User Query: ", 1)[1]
        if len(question) % 3 == 0:
            raise RuntimeError("model down")
        last = messages[-2]["content"] if len(messages) > 1 else ""
        digest = hashlib.md5(f"{last}|{question}".encode()).hexdigest()
        return f"{request['model']} at {request['temperature']}, message {len(messages)}: {digest}"


def chat_history(spark: SparkSession, sf: str) -> DataFrame:
    """Chat with a generator that reads the session's messages: each answer hangs on the one before."""
    replies = P_chat.chat_history_batch(views.faulty_events(spark, sf), _doc_index(spark, sf), _Recalls, RECALL)
    return replies.select("event_id", "channel", "thread_ts", "text", "status", "history_len")


def chat_history_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream: the events land in three parts in order of time, each part is a run of its own
    from the checkpoints, so that every session's messages cross micro-batches."""
    work = scratch_path(spark, f"chat-history-{uuid.uuid4().hex}")
    index = _doc_index(spark, sf)
    events = views.faulty_events(spark, sf).withColumn("second", F.coalesce(F.floor(ts_order("ts")), F.lit(-1)))
    third, rest = events.approxQuantile("second", [0.33, 0.67], 0.01)
    part = F.when(F.col("second") <= third, 0).when(F.col("second") <= rest, 1).otherwise(2)
    for k in range(3):
        events.where(part == k).drop("second").write.mode("append").parquet(f"{work}/events")
        _, _, out = S_chat.start(spark, f"{work}/events", lambda: index, work, RECALL, request_generator=_Recalls)
    return S_chat.read_replies(spark, out).select("event_id", "channel", "thread_ts", "text", "status", "history_len")


def response_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Landed model-service responses built from ``conversations``: assistant
    turns are chat responses, user turns embedding responses, system turns
    failures (plain text, JSON with an error, JSON without one); the fields
    are read back with JSON functions."""
    conv = views.table(spark, sf, "conversations")
    body = (
        F.when(F.col("role") == "assistant", F.to_json(F.struct(
            F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))))
        .when(F.col("role") == "user", F.to_json(F.struct(
            F.array(F.col("conv_id").cast("double"), F.col("turn").cast("double")).alias("embedding"))))
        .when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("error"))))
        .when(F.col("conv_id") % 3 == 1, F.to_json(F.struct(F.col("text").alias("detail"))))
        .otherwise(F.col("text"))
    )
    landed = conv.select("conv_id", "turn", body.alias("body"), F.when(F.col("role") == "system", 500).otherwise(200).alias("status"))
    return landed.select("conv_id", "turn", chat_content("body").alias("content"),
                         embedding_of("body").alias("embedding"), error_of("body", "status").alias("error"))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per channel: documents loaded, text sizes, embedded dimensions."""
    docs = documents.load_documents(views.messages(spark, sf), views.replies(spark, sf),
                                    views.users(spark, sf), Params())
    emb = P_ingest.embedded_documents(docs.drop("pos"))
    return emb.groupBy(F.col("metadata.channel_id").alias("channel_id")).agg(
        F.count("*").alias("n_docs"),
        F.sum(F.length("text")).alias("n_chars"),
        F.max(F.length("text")).alias("max_chars"),
        F.sum((F.col("embed_status") == "ok").cast("long")).alias("n_embedded"),
        F.max(F.size("embedding")).alias("dimensions"),
    )


def chat_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The chat as two streaming queries over landed event files; with
    in-order arrival the replies equal ``chat_batch``."""
    work = scratch_path(spark, f"chat-stream-{uuid.uuid4().hex}")
    views.events(spark, sf).write.parquet(f"{work}/events")
    index = _doc_index(spark, sf)
    _, _, out = S_chat.start(spark, f"{work}/events", lambda: index, work, Params(),
                             max_files_per_trigger=None)
    return S_chat.read_replies(spark, out).select(
        "event_id", "channel", "thread_ts", "text", "status", "history_len")


def chat_stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream observes of its turns and replies, over two runs of it from the checkpoints."""
    work = scratch_path(spark, f"chat-metrics-{uuid.uuid4().hex}")
    events, index = views.events(spark, sf), _doc_index(spark, sf)
    for part in (0, 1):
        events.where(F.pmod("event_id", F.lit(2)) == part).write.mode("append").parquet(f"{work}/events")
        S_chat.start(spark, f"{work}/events", lambda: index, work, Params())
    return S_chat.run_totals(S_chat.read_metrics(spark, work))


def chat_stream_json(spark: SparkSession, sf: str) -> DataFrame:
    """The chat over lines of JSON, some of them cut off: replies as in ``chat_stream``, and one row with the number
    of lines put aside."""
    work = scratch_path(spark, f"chat-json-{uuid.uuid4().hex}")
    views.event_lines(spark, sf).write.text(f"{work}/events")
    index = _doc_index(spark, sf)
    _, _, out = S_chat.start(spark, f"{work}/events", lambda: index, work, Params(), events_format="json")
    replies = S_chat.read_replies(spark, out).select("event_id", "channel", "thread_ts", "text", "status", "history_len")
    aside = S_chat.read_quarantine(spark, work).agg(F.count(F.lit(1)).alias("history_len"))
    return replies.unionByName(aside.withColumn("status", F.lit("unreadable lines")), allowMissingColumns=True)


def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental ingestion: first turns land, later turns arrive afterwards
    and re-stitch their (older) threads; the index ends equal to a full load."""
    work = scratch_path(spark, f"ingest-stream-{uuid.uuid4().hex}")
    msgs, reps = views.messages(spark, sf), views.replies(spark, sf)
    early = F.col("ts").endswith(".000000") | F.col("ts").endswith(".000001")
    chat.land_messages(msgs, f"{work}/messages")
    chat.land_replies(reps.where(early), f"{work}/replies")
    index = VectorIndex(spark, f"{work}/index")
    users = views.users(spark, sf)
    S_ingest.start(spark, f"{work}/messages", f"{work}/replies", users, index, work)
    chat.land_replies(reps.where(~early), f"{work}/replies")
    S_ingest.start(spark, f"{work}/messages", f"{work}/replies", users, index, work)
    return documents.flatten(index.read())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "message_filter": message_filter,
    "export_scan": export_scan,
    "channel_recent_cap": channel_recent_cap,
    "cap_before_filter": cap_before_filter,
    "thread_stitch": thread_stitch,
    "author_resolve": author_resolve,
    "build_documents": build_documents,
    "load_errors": load_errors,
    "load_truncate": load_truncate,
    "embed_documents": embed_documents,
    "embed_documents_sql": embed_documents_sql,
    "embed_errors": embed_errors,
    "index_upsert": index_upsert,
    "index_upsert_idempotent": index_upsert_idempotent,
    "ingest_run": ingest_run,
    "retrieve_topk": retrieve_topk,
    "retrieve_topk_cosine": retrieve_topk_cosine,
    "retrieve_topk_ivf": retrieve_topk_ivf,
    "retrieve_topk_stored": retrieve_topk_stored,
    "retrieve_topk_hashed": retrieve_topk_hashed,
    "retrieve_payload": retrieve_payload,
    "retrieve_questions": retrieve_questions,
    "event_route": event_route,
    "mention_strip": mention_strip,
    "small_talk": small_talk,
    "session_key": session_key,
    "session_key_scoped": session_key_scoped,
    "session_history": session_history,
    "context_block": context_block,
    "prompt_build": prompt_build,
    "answer_questions": answer_questions,
    "reply_route": reply_route,
    "chat_errors": chat_errors,
    "session_messages": session_messages,
    "chat_batch": chat_batch,
    "chat_history": chat_history,
    "chat_history_stream": chat_history_stream,
    "response_extract": response_extract,
    "run_metrics": run_metrics,
    "chat_stream": chat_stream,
    "chat_stream_json": chat_stream_json,
    "chat_stream_metrics": chat_stream_metrics,
    "ingest_stream": ingest_stream,
}
