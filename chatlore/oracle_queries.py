"""DuckDB twins of ``chatlore.queries`` (same names, same output columns)."""

from __future__ import annotations

from chatlore import oracle as O

W = O.with_views


def _docs(cap, truncate=False):
    return W(O.V_MESSAGES, O.V_REPLIES, O.V_USERS, O.documents_sql(cap, truncate=truncate))


_N_TOKENS = f"CAST(len({O.tokens('text')}) AS DOUBLE)"
_VECS = "v_vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SELF_PAIRS = "v_pairs AS (SELECT q.id AS question_id, c.id, {dist} AS distance FROM v_vecs q CROSS JOIN v_vecs c)"
_INDEX_DOCS = """v_idx AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, source AS channel_id, lang, doc_id
                          FROM documents)"""

ORACLE: dict[str, str] = {
    "message_filter": W(O.V_MESSAGES) + f"""
SELECT channel_id, ts, "user", coalesce(text, '') AS text, subtype, thread_ts
FROM v_messages WHERE channel_id IN ('C0', 'C2') AND {O.falsy('subtype')}""",

    "export_scan": W(O.V_MESSAGES) + """
SELECT channel_id, ts, "user", text, subtype, thread_ts, thread_ts IS NOT NULL AS has_thread
FROM v_messages WHERE thread_ts IS NULL OR thread_ts = ts""",

    "channel_recent_cap": W(O.V_DOC_MESSAGES, O.capped("v_doc_messages", 20)) + """
SELECT channel_id, ts, pos, "user" FROM v_capped""",

    "cap_before_filter": W(O.V_MESSAGES, O.capped("v_messages", 10)) + f"""
SELECT channel_id, ts, subtype FROM v_capped WHERE {O.falsy('subtype')}""",

    "thread_stitch": _docs(None) + """
SELECT r.channel_id, r.thread_ts, coalesce(s.replies_text, '') AS replies_text
FROM (SELECT DISTINCT channel_id, thread_ts FROM v_named_replies) r
LEFT JOIN v_stitched s USING (channel_id, thread_ts)""",

    "author_resolve": W(O.V_REPLIES, O.V_USERS) + f"""
SELECT r.channel_id, r.ts, r."user",
       {O.author('r."user"', 'u.user_id IS NOT NULL', 'u.real_name')} AS name
FROM v_replies r LEFT JOIN v_users u ON r."user" = u.user_id""",

    "build_documents": _docs(None) + """
SELECT id, text, author, slack_url, channel_id, timestamp FROM v_docs""",

    "load_errors": W(O.V_MESSAGES, O.V_FAULTY_MESSAGES) + f"""
SELECT channel_id, pos, "user", reason FROM v_faulty WHERE reason IS NOT NULL AND {O.falsy('subtype')}""",

    "load_truncate": W(O.V_MESSAGES, O.V_FAULTY_MESSAGES, O.V_REPLIES, O.V_USERS,
                       O.documents_sql(None, messages="v_faulty", truncate=True)) + """
SELECT id, text, author, slack_url, channel_id, timestamp FROM v_docs""",

    "embed_documents": W(O.hash_counts("v_cnt", "documents", "doc_id"),
                         O.dense("v_dense", "v_cnt", "documents", "doc_id")) + """
SELECT k AS doc_id, embedding FROM v_dense""",

    "embed_documents_sql": W(O.hash_counts("v_cnt", "documents", "doc_id"),
                             O.dense("v_dense", "v_cnt", "documents", "doc_id")) + """
SELECT k AS doc_id, embedding FROM v_dense""",

    "embed_errors": """
SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN 'error' ELSE 'ok' END AS embed_status,
       CASE WHEN length(text) % 7 = 0 THEN 'embedding failed for model ''hash'': model down' END AS embed_error,
       CASE WHEN length(text) % 7 = 0 THEN 0 ELSE 64 END AS dim FROM documents""",

    "index_upsert": W(_INDEX_DOCS, """v_run1 AS (SELECT id, text, channel_id FROM v_idx WHERE lang IN ('en', 'fr'))""",
                      """v_run2 AS (SELECT id, 'v2 ' || text AS text, channel_id FROM v_idx
                                    WHERE doc_id IN (SELECT doc_id FROM labels))""",
                      """v_final AS (SELECT id, text, channel_id FROM v_idx WHERE id NOT IN (SELECT id FROM v_run2)
                                     UNION ALL SELECT * FROM v_run2)""") + f"""
SELECT id, text, channel_id, {_N_TOKENS} AS emb_sum FROM v_final""",

    "index_upsert_idempotent": """
SELECT CAST(doc_id AS VARCHAR) AS id, text, 2 AS versions FROM documents""",

    "ingest_run": _docs(None) + f"""
SELECT id, text, author, slack_url, channel_id, timestamp, {_N_TOKENS} AS n_tokens FROM v_docs""",

    "retrieve_topk": W(_VECS, _SELF_PAIRS.format(dist=O.l2sq("q.e", "c.e"))) + f"""
SELECT question_id, id, rank, {O.rounded('distance')} AS distance FROM {O.topk('v_pairs')}""",

    "retrieve_topk_cosine": W(_VECS, _SELF_PAIRS.format(dist=O.cosine("q.e", "c.e"))) + f"""
SELECT question_id, id, rank, {O.rounded('distance')} AS distance FROM {O.topk('v_pairs')}""",

    "retrieve_topk_hashed": W(_VECS, _SELF_PAIRS.format(dist=O.l2sq("q.e", "c.e"))) + f"""
SELECT question_id, CAST(count(*) AS INTEGER) AS n_found, min({O.rounded('distance')}) AS nearest, TRUE AS recall_reached
FROM {O.topk('v_pairs')} GROUP BY question_id""",

    **dict.fromkeys(("retrieve_topk_ivf", "retrieve_topk_stored"), W(_VECS, _SELF_PAIRS.format(dist=O.l2sq("q.e", "c.e"))) + f"""
SELECT question_id, id, rank, {O.rounded('distance')} AS distance FROM {O.topk('v_pairs')}"""),

    "retrieve_payload": W(_VECS, """v_index AS (SELECT v.id, v.e, d.text, d.source
                                        FROM v_vecs v JOIN documents d ON d.doc_id = v.id)""",
                          f"""v_pairs AS (SELECT q.id AS question_id, c.id, {O.l2sq('q.e', 'c.e')} AS distance,
                                   c.text, c.source FROM v_vecs q CROSS JOIN v_index c)""") + f"""
SELECT question_id, id, rank, {O.rounded('distance')} AS distance, text, source FROM {O.topk('v_pairs')}""",

    "retrieve_questions": W(O.hash_counts("v_dc", "documents", "doc_id"),
                            O.hash_counts("v_qc", "benchmark", "item_id"),
                            O.sparse_l2sq_pairs("v_pairs", "benchmark", "item_id", "v_qc",
                                                "documents", "doc_id", "v_dc")) + f"""
SELECT question_id, rank, id, {O.rounded('distance')} AS distance FROM {O.topk('v_pairs')}""",

    "event_route": W(O.V_EVENTS, O.routed()) + """
SELECT event_id, kind FROM v_routed""",

    "mention_strip": W(O.V_EVENTS, O.routed(), O.prepared()) + """
SELECT event_id, kind, query FROM v_prep""",

    "small_talk": W(O.V_EVENTS, O.routed(), O.prepared()) + """
SELECT event_id, small_talk FROM v_prep""",

    "session_key": W(O.V_EVENTS, O.routed(), O.prepared()) + """
SELECT event_id, session_key, reply_thread_ts FROM v_prep""",

    "session_key_scoped": W(O.V_EVENTS, O.routed(), O.prepared()) + """
SELECT coalesce(channel, '') || ':' || session_key AS session_key, count(*) AS n_events, min(event_id) AS first_event
FROM v_prep GROUP BY 1""",

    "session_history": W(O.V_EVENTS, O.V_DOC_MESSAGES, O.V_USERS, O.chat_turns()) + """
SELECT event_id, session_key, history_len FROM v_turns""",

    "context_block": W(O.V_DOC_MESSAGES, O.V_USERS, O.V_DM_DOCS,
                       "v_bq AS (SELECT DISTINCT text FROM benchmark)", O.answers("v_bq")) + """
SELECT b.item_id AS question_id, a.context, a.bare_context, a.n_docs
FROM benchmark b JOIN v_answers a ON a.query = b.text""",

    "prompt_build": W(O.V_DOC_MESSAGES, O.V_USERS, O.V_DM_DOCS,
                      "v_bq AS (SELECT DISTINCT text FROM benchmark)", O.answers("v_bq")) + """
SELECT b.item_id AS question_id, a.prompt, a.instruction, 1 AS n_messages
FROM benchmark b JOIN v_answers a ON a.query = b.text""",

    "answer_questions": W(O.V_DOC_MESSAGES, O.V_USERS, O.V_DM_DOCS,
                          "v_bq AS (SELECT DISTINCT text FROM benchmark)", O.answers("v_bq")) + """
SELECT b.item_id AS question_id, a.answer, 'ok' AS status
FROM benchmark b JOIN v_answers a ON a.query = b.text""",

    "reply_route": W(O.V_EVENTS, O.V_DOC_MESSAGES, O.V_USERS, O.chat_turns()) + """
SELECT event_id, channel, thread_ts, status, kind FROM v_replies_out""",

    "chat_errors": W(O.V_EVENTS.replace("v_events AS", "v_all_events AS"), O.V_FAULTY_EVENTS, O.failing_chat()) + """
SELECT event_id, session_key, text_out AS text, status, history_len FROM v_turns""",

    "session_messages": W(O.V_EVENTS.replace("v_events AS", "v_all_events AS"), O.V_FAULTY_EVENTS, O.failing_chat(),
                          """v_before AS (
  SELECT event_id, query, list(CASE WHEN status = 'ok' THEN 'user: ' || query || chr(10) || 'assistant: ' || text_out END) OVER (
           PARTITION BY session_key ORDER BY CAST(ts AS DECIMAL(20,6)) NULLS FIRST, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM v_turns WHERE NOT small_talk)""",
                          """v_list AS (SELECT event_id, query, list_filter(coalesce(earlier, []), lambda x: x IS NOT NULL) AS e FROM v_before)""") + """
SELECT event_id, CAST(2 * len(e) + 1 AS INTEGER) AS n_messages,
       md5(CASE WHEN len(e) > 0 THEN array_to_string(e, chr(10)) || chr(10) ELSE '' END || 'user: ' || query) AS messages_md5
FROM v_list""",

    "chat_batch": W(O.V_EVENTS, O.V_DOC_MESSAGES, O.V_USERS, O.chat_turns()) + """
SELECT event_id, channel, thread_ts, text, status, history_len FROM v_replies_out""",

    **dict.fromkeys(("chat_history", "chat_history_stream"), W(
        O.V_EVENTS.replace("v_events AS", "v_all_events AS"), O.V_FAULTY_EVENTS, O.recalling_chat()).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT event_id, channel, thread_ts, text, status, history_len FROM v_replies_out"""),

    "response_extract": """
WITH landed AS (
  SELECT conv_id, turn, role,
         CASE WHEN role = 'assistant' THEN to_json({'message': {'role': 'assistant', 'content': text}})::VARCHAR
              WHEN role = 'user' THEN to_json({'embedding': [conv_id::DOUBLE, turn::DOUBLE]})::VARCHAR
              WHEN conv_id % 3 = 0 THEN to_json({'error': text})::VARCHAR
              WHEN conv_id % 3 = 1 THEN to_json({'detail': text})::VARCHAR
              ELSE text END AS body, text
  FROM conversations)
SELECT conv_id, turn,
       CASE WHEN role = 'assistant' THEN json_extract_string(body, '$.message.content') END AS content,
       CASE WHEN role = 'user' THEN CAST(json_extract(body, '$.embedding') AS DOUBLE[]) END AS embedding,
       CASE WHEN role = 'system' THEN CASE WHEN conv_id % 3 = 0 THEN text ELSE body END END AS error
FROM landed""",

    "run_metrics": _docs(None) + """
SELECT channel_id, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(max(length(text)) AS INTEGER) AS max_chars, count(*) AS n_embedded, 64 AS dimensions
FROM v_docs GROUP BY channel_id""",

    "chat_stream": W(O.V_EVENTS, O.V_DOC_MESSAGES, O.V_USERS, O.chat_turns()) + """
SELECT event_id, channel, thread_ts, text, status, history_len FROM v_replies_out""",

    "chat_stream_metrics": W(O.V_EVENTS, O.V_DOC_MESSAGES, O.V_USERS, O.chat_turns()) + """,
v_sizes AS (
  SELECT (SELECT count(*) FROM v_prep) AS turns, (SELECT sum(length(query)) FROM v_prep) AS query_chars,
         sum(length(a.instruction)) AS instruction_chars, max(length(a.instruction)) AS instruction_chars_max
  FROM v_prep p JOIN v_answers a ON a.query = p.query WHERE NOT p.small_talk),
v_out AS (
  SELECT count(*) AS replies, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'greeting') AS greetings,
         sum(history_len) AS history_messages, max(history_len) AS history_messages_max,
         sum(length(text)) AS response_chars, max(length(text)) AS response_chars_max
  FROM v_replies_out)
SELECT metric, CAST(value AS BIGINT) AS value FROM (
  SELECT unnest(['turns', 'query_chars', 'instruction_chars', 'instruction_chars_max']) AS metric,
         unnest([turns, query_chars, instruction_chars, instruction_chars_max]) AS value FROM v_sizes
  UNION ALL
  SELECT unnest(['replies', 'errors', 'greetings', 'history_messages', 'history_messages_max', 'response_chars', 'response_chars_max']),
         unnest([replies, errors, greetings, history_messages, history_messages_max, response_chars, response_chars_max]) FROM v_out)""",

    "chat_stream_json": W(O.V_EVENTS, O.V_DOC_MESSAGES, O.V_USERS, O.chat_turns()) + """
SELECT event_id, channel, thread_ts, text, status, history_len FROM v_replies_out
UNION ALL
SELECT NULL, NULL, NULL, NULL, 'unreadable lines', count(*) FROM v_events WHERE event_id % 23 = 0""",

    "ingest_stream": _docs(None) + """
SELECT id, text, author, slack_url, channel_id, timestamp FROM v_docs""",
}
