"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each view of ``chatlore.sources.views`` has a CTE here with the same
formulas; each query is ``WITH <views> SELECT ...`` over the driver tables.
"""

from __future__ import annotations

from chatlore import config as C


def lit(s: str) -> str:
    """A DuckDB string expression equal to ``s`` (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


STRIP_RE = f"^{C.PY_SPACE_CLASS}+|{C.PY_SPACE_CLASS}+$"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP_RE}', '', 'g')"


def mention_strip(expr: str) -> str:
    return (f"CASE WHEN strpos({expr}, '>') > 0 "
            f"THEN {py_strip(f'substr({expr}, strpos({expr}, {lit(chr(62))}) + 1)')} ELSE {expr} END")


def falsy(expr: str) -> str:
    return f"({expr} IS NULL OR {expr} = '')"


def author(user: str, matched: str, real: str) -> str:
    return (f"CASE WHEN {falsy(user)} THEN {lit(C.UNKNOWN_AUTHOR)} "
            f"WHEN {matched} THEN {real} ELSE {user} END")


def turn_ts(conv: str, turn: str) -> str:
    return f"(CAST(1704067200 + {conv} AS VARCHAR) || '.' || lpad(CAST({turn} AS VARCHAR), 6, '0'))"


def permalink(channel: str, ts: str, domain: str = C.DEFAULT_DOMAIN) -> str:
    return f"('https://{domain}.slack.com/archives/' || {channel} || '/p' || replace({ts}, '.', ''))"


def reply_line(name: str, text: str) -> str:
    return f"({lit(chr(10) * 2 + '[Reply from ')} || {name} || ']: ' || coalesce({text}, ''))"


CONV_COLS = f"""
    'C' || CAST(conv_id % 4 AS VARCHAR) AS channel_id,
    {turn_ts('conv_id', 'turn')} AS ts,
    CASE WHEN conv_id % 7 = 0 THEN NULL ELSE 'U' || CAST((conv_id * 31 + turn) % 2000 AS VARCHAR) END AS "user",
    CASE WHEN role = 'system' THEN 'channel_join' WHEN conv_id % 10 = 3 THEN '' ELSE NULL END AS subtype,
    CASE WHEN conv_id % 5 = 0 THEN NULL ELSE {turn_ts('conv_id', '0')} END AS thread_ts"""

V_MESSAGES = f"""v_messages AS (
  SELECT {CONV_COLS}, -conv_id AS pos, text, conv_id
  FROM conversations WHERE turn = 0)"""

V_REPLIES = f"""v_replies AS (
  SELECT 'C' || CAST(conv_id % 4 AS VARCHAR) AS channel_id, {turn_ts('conv_id', '0')} AS thread_ts,
         {turn_ts('conv_id', 'turn')} AS ts,
         CASE WHEN conv_id % 7 = 0 THEN NULL ELSE 'U' || CAST((conv_id * 31 + turn) % 2000 AS VARCHAR) END AS "user",
         text
  FROM conversations)"""

V_USERS = """v_users AS (
  SELECT 'U' || CAST(c_custkey AS VARCHAR) AS user_id, c_name AS real_name FROM customer)"""

V_FAULTY_MESSAGES = """v_faulty AS (
  SELECT * REPLACE (CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 13 = 0 THEN '' ELSE ts END AS ts,
                    CASE WHEN conv_id % 9 <> 0 THEN text END AS text),
         CASE WHEN conv_id % 11 = 0 THEN 'missing ts' WHEN conv_id % 13 = 0 THEN 'malformed ts'
              WHEN conv_id % 9 = 0 AND thread_ts IS NOT NULL THEN 'null text in a thread' END AS reason
  FROM v_messages)"""

V_FAULTY_EVENTS = """v_events AS (
  SELECT * REPLACE (CASE WHEN event_id % 13 <> 0 THEN "user" END AS "user", CASE WHEN event_id % 19 <> 0 THEN ts END AS ts)
  FROM v_all_events)"""

V_DOC_MESSAGES = """v_doc_messages AS (
  SELECT source AS channel_id, -doc_id AS pos,
         CAST(1704067200 + doc_id AS VARCHAR) || '.000000' AS ts,
         'U' || CAST(doc_id % 2000 AS VARCHAR) AS "user", text,
         CAST(NULL AS VARCHAR) AS subtype, CAST(NULL AS VARCHAR) AS thread_ts
  FROM documents)"""

V_EVENTS = """v_events AS (
  SELECT e.event_id,
         CASE WHEN e.event_type = 'click' THEN 'app_mention' ELSE 'message' END AS type,
         CASE WHEN e.event_type IN ('click', 'error') THEN 'C' || CAST(e.user_id % 4 AS VARCHAR)
              ELSE 'D' || CAST(e.user_id AS VARCHAR) END AS channel,
         CASE WHEN e.event_type IN ('view', 'purchase', 'signup') THEN 'im'
              WHEN e.event_type = 'error' THEN 'channel' ELSE NULL END AS channel_type,
         CAST(epoch_us(e.ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(e.ts) % 1000000 AS VARCHAR), 6, '0') AS ts,
         CASE WHEN e.event_id % 3 = 0 THEN CAST((epoch_us(e.ts) // 86400000000) * 86400 AS VARCHAR) || '.000000'
              ELSE NULL END AS thread_ts,
         'U' || CAST(e.user_id AS VARCHAR) AS "user",
         CASE WHEN e.event_id % 17 = 0 THEN 'B1' ELSE NULL END AS bot_id,
         CASE WHEN e.event_type = 'click' THEN ' <@U1> ' || b.text
              WHEN e.event_id % 11 = 0 THEN 'Hello ' ELSE b.text END AS text
  FROM events e LEFT JOIN benchmark b
    ON b.item_id = e.event_id % (SELECT count(*) FROM benchmark))"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def capped(source: str, cap: int | None, name: str = "v_capped") -> str:
    if cap is None:
        return f"{name} AS (SELECT * FROM {source})"
    return (f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER "
            f"(PARTITION BY channel_id ORDER BY CAST(ts AS DECIMAL(20,6)) DESC, pos) <= {cap})")


def documents_sql(cap: int | None, domain: str = C.DEFAULT_DOMAIN, messages: str = "v_messages",
                  truncate: bool = False) -> str:
    """CTEs ending in ``v_docs(id, text, author, slack_url, channel_id, timestamp, pos)``."""
    kept_filter = f"WHERE {falsy('subtype')}"
    trunc = ""
    kept_src = "v_kept0"
    if truncate:
        trunc = """,
v_first_bad AS (SELECT channel_id, min(pos) AS first_bad FROM v_kept0 WHERE reason IS NOT NULL GROUP BY channel_id),
v_kept1 AS (SELECT k.* FROM v_kept0 k LEFT JOIN v_first_bad f USING (channel_id)
            WHERE f.first_bad IS NULL OR k.pos < f.first_bad)"""
        kept_src = "v_kept1"
    else:
        trunc = """,
v_kept1 AS (SELECT * FROM v_kept0 WHERE ts IS NOT NULL)"""
        kept_src = "v_kept1"
    return f"""{capped(messages, cap)},
v_kept0 AS (SELECT * FROM v_capped {kept_filter}){trunc},
v_kept AS (SELECT * REPLACE (coalesce(text, '') AS text) FROM {kept_src}),
v_named_replies AS (
  SELECT r.channel_id, r.thread_ts, r.ts, r.text,
         {author('r."user"', 'u.user_id IS NOT NULL', 'u.real_name')} AS name
  FROM v_replies r LEFT JOIN v_users u ON r."user" = u.user_id
  WHERE (r.channel_id, r.thread_ts) IN (SELECT (channel_id, thread_ts) FROM v_kept WHERE thread_ts IS NOT NULL)),
v_ranked_replies AS (
  SELECT *, row_number() OVER (PARTITION BY channel_id, thread_ts
                               ORDER BY CAST(ts AS DECIMAL(20,6)), {reply_line('name', 'text')}) AS k
  FROM v_named_replies),
v_stitched AS (
  SELECT channel_id, thread_ts, string_agg({reply_line('name', 'text')}, '' ORDER BY k) AS replies_text
  FROM v_ranked_replies WHERE k > 1 GROUP BY channel_id, thread_ts),
v_docs AS (
  SELECT sha256(m.channel_id || '_' || m.ts) AS id,
         CASE WHEN m.thread_ts IS NOT NULL THEN m.text || coalesce(s.replies_text, '') ELSE m.text END AS text,
         {author('m."user"', 'u.user_id IS NOT NULL', 'u.real_name')} AS author,
         {permalink('m.channel_id', 'm.ts', domain)} AS slack_url,
         m.channel_id, m.ts AS timestamp, m.pos
  FROM v_kept m
  LEFT JOIN v_users u ON m."user" = u.user_id
  LEFT JOIN v_stitched s ON m.channel_id = s.channel_id AND m.thread_ts = s.thread_ts)"""


TOKEN_RE = r"[\p{L}\p{N}]+"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN_RE}')"


def hash_counts(name: str, source: str, key: str, dim: int = 64) -> str:
    """``name(k, b, n)``: token counts per hash bucket (sparse embedding)."""
    return f"""{name} AS (
  SELECT k, (('0x' || substr(md5(tok), 1, 6))::BIGINT) % {dim} AS b, count(*) AS n
  FROM (SELECT {key} AS k, unnest({tokens('text')}) AS tok FROM {source})
  GROUP BY k, b)"""


def dense(name: str, counts: str, source: str, key: str, dim: int = 64) -> str:
    """``name(k, embedding FLOAT[])`` from sparse counts; no token = zero vector."""
    return f"""{name} AS (
  SELECT s.{key} AS k, list(CAST(coalesce(c.n, 0) AS FLOAT) ORDER BY g.b) AS embedding
  FROM {source} s CROSS JOIN (SELECT range AS b FROM range({dim})) g
  LEFT JOIN {counts} c ON c.k = s.{key} AND c.b = g.b
  GROUP BY s.{key})"""


def l2sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) ** 2))"


def cosine(a: str, b: str) -> str:
    return f"(1.0 - list_cosine_similarity({a}, {b}))"


def rounded(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def topk(pairs: str, k: int = 5, qid: str = "question_id") -> str:
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY {qid} ORDER BY distance, id) AS INTEGER) AS rank
  FROM {pairs}) WHERE rank <= {k}"""


def sparse_l2sq_pairs(name: str, qsrc: str, qkey: str, qcounts: str, csrc: str, ckey: str,
                      ccounts: str) -> str:
    """Exact squared L2 between sparse count vectors of every (question, doc)."""
    return f"""{name}_qn AS (SELECT k, sum(n * n) AS sq FROM {qcounts} GROUP BY k),
{name}_cn AS (SELECT k, sum(n * n) AS sq FROM {ccounts} GROUP BY k),
{name}_dots AS (SELECT q.k AS qk, c.k AS ck, sum(q.n * c.n) AS dot
                FROM {qcounts} q JOIN {ccounts} c ON q.b = c.b GROUP BY q.k, c.k),
{name} AS (
  SELECT q.{qkey} AS question_id, c.{ckey} AS id,
         CAST(coalesce(qn.sq, 0) + coalesce(cn.sq, 0) - 2 * coalesce(d.dot, 0) AS DOUBLE) AS distance
  FROM {qsrc} q CROSS JOIN {csrc} c
  LEFT JOIN {name}_qn qn ON qn.k = q.{qkey}
  LEFT JOIN {name}_cn cn ON cn.k = c.{ckey}
  LEFT JOIN {name}_dots d ON d.qk = q.{qkey} AND d.ck = c.{ckey})"""


def routed() -> str:
    dm = "type = 'message' AND channel_type = 'im'"
    return f"""v_routed AS (
  SELECT *, CASE WHEN type = 'app_mention' AND text IS NULL THEN 'no_text'
                 WHEN type = 'app_mention' THEN 'mention'
                 WHEN {dm} AND NOT {falsy('bot_id')} THEN 'bot'
                 WHEN {dm} AND text IS NULL THEN 'no_text'
                 WHEN {dm} THEN 'dm' ELSE 'ignored' END AS kind
  FROM v_events)"""


def prepared() -> str:
    q = f"CASE WHEN kind = 'mention' THEN {mention_strip(py_strip('text'))} ELSE {py_strip('text')} END"
    return f"""v_prep0 AS (SELECT *, {q} AS query FROM v_routed WHERE kind IN ('mention', 'dm')),
v_prep AS (
  SELECT *, (kind <> 'mention' AND lower(query) IN {in_list(C.SMALL_TALK)}) AS small_talk,
         CASE WHEN kind = 'mention' THEN coalesce(thread_ts, ts)
              WHEN {falsy('thread_ts')} THEN "user" ELSE thread_ts END AS session_key,
         CASE WHEN kind = 'mention' THEN coalesce(thread_ts, ts)
              WHEN {falsy('thread_ts')} THEN NULL ELSE thread_ts END AS reply_thread_ts
  FROM v_prep0)"""


V_DM_DOCS = f"""v_dm_docs AS (
  SELECT sha256(m.channel_id || '_' || m.ts) AS id, coalesce(m.text, '') AS text,
         {author('m."user"', 'u.user_id IS NOT NULL', 'u.real_name')} AS author,
         {permalink('m.channel_id', 'm.ts')} AS url
  FROM v_doc_messages m LEFT JOIN v_users u ON m."user" = u.user_id)"""


def answers(questions: str) -> str:
    """CTEs from ``questions(text)`` (distinct) to ``v_ans(query, context,
    bare_context, n_docs, prompt, instruction, answer)`` over ``v_dm_docs``."""
    sep = lit(C.CONTEXT_SEPARATOR)
    header = (f"'[Source: ' || coalesce(d.url, {lit(C.MISSING_URL)}) || ' | Author: ' || "
              f"coalesce(d.author, {lit(C.MISSING_AUTHOR)}) || ']' || chr(10) || coalesce(d.text, '')")
    cited = (f"'According to ' || coalesce(b.best_author, {lit(C.MISSING_AUTHOR)}) || ' (' || "
             f"coalesce(b.best_url, {lit(C.MISSING_URL)}) || '):' || chr(10) || coalesce(b.best_text, '')")
    return f"""{hash_counts('v_qc', questions, 'text')},
{hash_counts('v_dc', 'v_dm_docs', 'id')},
{sparse_l2sq_pairs('v_pairs', questions, 'text', 'v_qc', 'v_dm_docs', 'id', 'v_dc')},
v_top AS (SELECT * FROM {topk('v_pairs')}),
v_blocks AS (
  SELECT t.question_id AS qtext,
         string_agg({header}, {sep} ORDER BY t.rank) AS context,
         string_agg(coalesce(d.text, ''), {sep} ORDER BY t.rank) AS bare_context,
         count(*) AS n_docs,
         max(CASE WHEN t.rank = 1 THEN d.text END) AS best_text,
         max(CASE WHEN t.rank = 1 THEN d.author END) AS best_author,
         max(CASE WHEN t.rank = 1 THEN d.url END) AS best_url
  FROM v_top t JOIN v_dm_docs d ON d.id = t.id GROUP BY t.question_id),
v_ans AS (
  SELECT q.text AS query, coalesce(b.context, '') AS context, coalesce(b.bare_context, '') AS bare_context,
         CAST(coalesce(b.n_docs, 0) AS INTEGER) AS n_docs,
         CASE WHEN coalesce(b.n_docs, 0) > 0 THEN {cited} ELSE {lit(C.NO_CONTEXT_ANSWER)} END AS answer
  FROM {questions} q LEFT JOIN v_blocks b ON b.qtext = q.text),
v_ans2 AS (
  SELECT *, {lit(C.DEFAULT_SYSTEM_PROMPT + chr(10) * 2 + 'Context:' + chr(10))} || context
            || chr(10) || chr(10) || 'User Query: ' || query AS prompt
  FROM v_ans),
v_answers AS (
  SELECT *, {lit('Use the following context to answer the user.' + chr(10) * 2 + 'Context:' + chr(10))}
            || bare_context || chr(10) || chr(10) || 'User Prompt: ' || prompt AS instruction
  FROM v_ans2)"""


def failing_chat() -> str:
    """CTEs ending in ``v_turns``: every event of ``v_prep`` with its reply under the failing models."""
    order = "CAST(ts AS DECIMAL(20,6)) NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""{routed()},
{prepared()},
v_status AS (
  SELECT *, CASE WHEN small_talk THEN 'greeting' WHEN length(query) % 7 = 0 OR length(query) % 3 = 0 THEN 'error' ELSE 'ok' END AS status
  FROM v_prep),
v_turns AS (
  SELECT *, CASE status WHEN 'greeting' THEN {lit(C.DEFAULT_GREETING)}
                        WHEN 'ok' THEN 'answer to: ' || query
                        ELSE 'I encountered an error while consulting the archives.' END AS text_out,
         CASE WHEN NOT small_talk THEN CAST(2 * coalesce(count(*) FILTER (status = 'ok') OVER (
           PARTITION BY session_key ORDER BY {order}), 0) AS BIGINT) END AS history_len
  FROM v_status)"""


def chat_turns() -> str:
    """CTEs ending in ``v_turns`` (answered events with history_len) and
    ``v_replies_out`` (all replies incl. greetings)."""
    return f"""{routed()},
{prepared()},
{V_DM_DOCS},
v_q AS (SELECT DISTINCT query AS text FROM v_prep WHERE NOT small_talk),
{answers('v_q')},
v_turns AS (
  SELECT p.event_id, p.channel, p.reply_thread_ts AS thread_ts, a.answer AS text, 'ok' AS status, p.kind,
         p.session_key,
         CAST(2 * coalesce(count(*) OVER (PARTITION BY p.session_key ORDER BY CAST(p.ts AS DECIMAL(20,6)), p.event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history_len
  FROM v_prep p JOIN v_answers a ON a.query = p.query WHERE NOT p.small_talk),
v_replies_out AS (
  SELECT * FROM v_turns
  UNION ALL
  SELECT event_id, channel, reply_thread_ts AS thread_ts, {lit(C.DEFAULT_GREETING)} AS text, 'greeting' AS status,
         kind, session_key, CAST(NULL AS BIGINT) AS history_len
  FROM v_prep WHERE small_talk)"""


def recalling_chat() -> str:
    """CTEs ending in ``v_replies_out`` of a generator whose answer hangs on its answer before (a recursion
    over the turns of each session)."""
    return f"""{routed()},
{prepared()},
v_seq AS (
  SELECT *, length(query) % 3 <> 0 AS up,
         row_number() OVER (PARTITION BY session_key ORDER BY CAST(ts AS DECIMAL(20,6)) NULLS FIRST, event_id) AS rn
  FROM v_prep WHERE NOT small_talk),
v_chain(event_id, session_key, rn, up, history_len, text, held, last) AS (
  SELECT event_id, session_key, rn, up, 0::BIGINT,
         CASE WHEN up THEN 'recall at 0.25, message 1: ' || md5('|' || query) ELSE 'I encountered an error while consulting the archives.' END,
         CASE WHEN up THEN 2 ELSE 0 END::BIGINT, CASE WHEN up THEN 'recall at 0.25, message 1: ' || md5('|' || query) ELSE '' END
  FROM v_seq WHERE rn = 1
  UNION ALL
  SELECT s.event_id, s.session_key, s.rn, s.up, c.held,
         CASE WHEN s.up THEN 'recall at 0.25, message ' || (c.held + 1) || ': ' || md5(c.last || '|' || s.query)
              ELSE 'I encountered an error while consulting the archives.' END,
         c.held + CASE WHEN s.up THEN 2 ELSE 0 END,
         CASE WHEN s.up THEN 'recall at 0.25, message ' || (c.held + 1) || ': ' || md5(c.last || '|' || s.query) ELSE c.last END
  FROM v_chain c JOIN v_seq s ON s.session_key IS NOT DISTINCT FROM c.session_key AND s.rn = c.rn + 1),
v_replies_out AS (
  SELECT p.event_id, p.channel, p.reply_thread_ts AS thread_ts,
         CASE WHEN p.small_talk THEN {lit(C.DEFAULT_GREETING)} ELSE c.text END AS text,
         CASE WHEN p.small_talk THEN 'greeting' WHEN c.up THEN 'ok' ELSE 'error' END AS status, c.history_len
  FROM v_prep p LEFT JOIN v_chain c ON c.event_id = p.event_id)"""
