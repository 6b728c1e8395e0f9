"""Events as lines of JSON, the quarantine, and memory per channel."""

from __future__ import annotations

import json
import uuid

import pytest

from chatlore import schemas
from chatlore.config import Params
from chatlore.operators import events as EV
from chatlore.session import scratch_path
from chatlore.sources import json_events as J
from chatlore.streaming import chat_stream as S

MENTION = {"type": "app_mention", "channel": "C1", "ts": "5.0", "user": "U1", "text": "<@B> where?"}


def body(event_id, **changes):
    return json.dumps({"event_id": event_id, "event": {**MENTION, **changes}})


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_key_presence(spark):
    bare = {k: v for k, v in MENTION.items() if k != "text"}
    parsed = J.parse_events(lines(spark, [body(1), body(2, thread_ts=None), body(3, thread_ts="4.0"), body(4, text=None),
                                          json.dumps({"event_id": 5, "event": bare}), body(6, text=12, extra={"a": [1]})]))
    assert J.unreadable(parsed).count() == 0
    got = {r.event_id: r for r in EV.prepare(J.readable(parsed)).collect()}
    assert {k: r.session_key for k, r in got.items()} == {1: "5.0", 2: None, 3: "4.0", 5: "5.0", 6: "5.0"}   # 4 gets no reply
    assert (got[1].query, got[5].query, got[6].query) == ("where?", "", "12")


def test_unreadable_lines_have_a_reason(spark):
    rows = [body(1)[:-4], "[1, 2]", "word", "", "   ", "{}", json.dumps({"event_id": 3}), json.dumps({"event": MENTION}),
            json.dumps({"event_id": "x", "event": MENTION}), json.dumps({"event_id": 4, "event": "text"}), body(7)]
    parsed = J.parse_events(lines(spark, rows))
    aside = {r.line: r.reason for r in J.unreadable(parsed).collect()}
    assert [r.event_id for r in J.readable(parsed).collect()] == [7]
    assert set(aside) == {r for r in rows[:-1] if r.strip()}
    assert (aside[rows[6]], aside[rows[7]], aside["word"]) == (J.NO_EVENT, J.NO_ID, J.NOT_JSON)


def test_stream_over_json_puts_lines_aside_once(spark):
    work = scratch_path(spark, f"json-{uuid.uuid4().hex}")
    index = spark.createDataFrame([], schemas.DOCUMENTS)
    for k in range(2):
        lines(spark, [body(2 * k, ts=f"{k}.0", thread_ts="t"), body(9)[:20], f"bad {k}"]).coalesce(1).write.mode("append").text(f"{work}/events")
        _, _, out = S.start(spark, f"{work}/events", lambda: index, work, events_format="json")
    got = {r.event_id: (r.status, r.history_len) for r in S.read_replies(spark, out).collect()}
    assert got == {0: ("ok", 0), 2: ("ok", 2)}
    aside = S.read_quarantine(spark, work)
    assert sorted(r.line for r in aside.collect()) == sorted([body(9)[:20]] * 2 + ["bad 0", "bad 1"])
    replay = J.parse_events(lines(spark, ["bad 1", body(9)[:20]]))
    S._turns_batch(lambda: index, Params(), None, None, f"{work}/turns", f"{work}/quarantine")(replay, 1)
    assert S.read_quarantine(spark, work).count() == 4


def test_format_is_checked_and_no_quarantine_is_empty(spark):
    with pytest.raises(ValueError):
        S.start(spark, "x", None, "y", events_format="csv")
    assert S.read_quarantine(spark, scratch_path(spark, uuid.uuid4().hex)).count() == 0


def test_memory_per_channel(spark):
    rows = [(1, "app_mention", "C1", None, "1.0", "9.0", "U1", None, "q"), (2, "app_mention", "C2", None, "2.0", "9.0", "U1", None, "q"),
            (3, "app_mention", None, None, "3.0", None, "U1", None, "q"), (4, "message", "D1", "im", "4.0", None, None, None, "q")]
    events = spark.createDataFrame(rows, schemas.EVENTS)
    keys = {s: {r.event_id: r.session_key for r in EV.prepare(events, scope_by_channel=s).collect()} for s in (False, True)}
    assert keys[False] == {1: "9.0", 2: "9.0", 3: "3.0", 4: None}
    assert keys[True] == {1: "C1:9.0", 2: "C2:9.0", 3: ":3.0", 4: None}
