"""Landed chat exports read into the loader."""

import json
import os
import uuid

from chatlore.config import Params
from chatlore.operators import documents as D
from chatlore.session import scratch_path
from chatlore.sources import chat


def test_read_export_and_load(spark):
    root = scratch_path(spark, f"export-{uuid.uuid4().hex}").replace("file:", "")
    day1 = [
        {"ts": "100.000001", "user": "U1", "text": "parent", "thread_ts": "100.000001"},
        {"ts": "100.000002", "user": "U2", "text": "reply a", "thread_ts": "100.000001"},
        {"ts": "101.000000", "user": "U1", "subtype": "channel_join", "text": "joined"},
        {"ts": "102.000000", "user": "U9"},
    ]
    day2 = [{"ts": "200.000000", "user": "U2", "text": "reply b", "thread_ts": "100.000001"}]
    for name, rows in (("2024-01-01.json", day1), ("2024-01-02.json", day2)):
        os.makedirs(f"{root}/C7", exist_ok=True)
        with open(f"{root}/C7/{name}", "w") as fh:
            json.dump(rows, fh)
    messages, replies = chat.read_export(spark, root)
    assert messages.count() == 3 and replies.count() == 3
    users = spark.createDataFrame([("U1", "Ann"), ("U2", "Bo")], "user_id string, real_name string")
    docs = {d.metadata.timestamp: d for d in D.load_documents(messages, replies, users, Params()).collect()}
    assert sorted(docs) == ["100.000001", "102.000000"]
    assert docs["100.000001"].text == "parent\n\n[Reply from Bo]: reply a\n\n[Reply from Bo]: reply b"
    assert docs["102.000000"].text == "" and docs["102.000000"].metadata.author == "U9"
    assert docs["100.000001"].metadata.channel_id == "C7"


def test_landing_keeps_key_presence(spark):
    """An absent and a null ``thread_ts`` stay apart through a landing; a null text in a thread is a load error."""
    from chatlore.operators import messages as M

    raw = spark.createDataFrame([("C1", 1, '{"ts": "1.0", "text": "a"}'), ("C1", 2, '{"ts": "2.0", "text": null, "thread_ts": null}'),
                                 ("C2", 3, '{"ts": "3.0", "thread_ts": "3.0", "text": "b"}'), ("C2", 4, '{"ts": "4.0"}')],
                                "channel_id string, pos long, body string")
    path = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    chat.land_messages(chat.parse_raw_messages(raw), path)
    back = chat.read_messages(spark, path)
    assert {r.pos: r.has_thread for r in back.collect()} == {1: False, 2: True, 3: True, 4: False}
    assert [(r.pos, r.reason) for r in M.load_errors(back).collect()] == [(2, "null text in a thread")]
    assert "PartitionFilters: [isnotnull(channel_id" in back.where("channel_id = 'C1'")._jdf.queryExecution().executedPlan().toString()


def test_touched_keys_prune_the_landings(spark, monkeypatch):
    """Keys become partition filters on channel and day; messages of another's thread are found as well."""
    day = 86_400
    rows = [(c, k, f"{day * d + k}.0", "U", f"{c}{d}{k}", None, f"{day * d + k}.0" if k == 1 else None)
            for c in ("C1", "C2") for d in range(3) for k in range(3)]
    rows.append(("C2", 9, f"{day * 2 + 50}.0", "U", "broadcast", None, f"{day}.0"))     # names a thread of another day
    messages = spark.createDataFrame(rows, "channel_id string, pos long, ts string, user string, text string, subtype string, thread_ts string")
    path = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    chat.land_messages(messages, f"{path}/m")
    chat.land_replies(messages.where("thread_ts IS NOT NULL").select("channel_id", "thread_ts", "ts", "user", "text"), f"{path}/r")
    keys = spark.createDataFrame([("C2", f"{day}.0"), ("C2", f"{day + 1}.0")], "channel_id string, key_ts string")
    from chatlore.streaming.ingest_stream import touched_parents

    narrowed = chat.read_messages(spark, f"{path}/m", keys)
    plan = narrowed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {(r.channel_id, r.ts) for r in narrowed.collect()} == {("C2", f"{day + k}.0") for k in range(3)} | {("C2", f"{day * 2 + 50}.0")}
    found = touched_parents(narrowed, keys)
    assert sorted(r.text for r in found.collect()) == ["C210", "C211", "broadcast"]
    assert {r.text: r.has_thread for r in found.collect()} == {"C210": False, "C211": True, "broadcast": True}
    assert [r.text for r in chat.read_replies(spark, f"{path}/r", keys).collect() if r.text != "broadcast"] == ["C211"]
    monkeypatch.setattr(chat, "MAX_PLACES", 1)     # too many to name: the join alone
    assert sorted(r.text for r in touched_parents(chat.read_messages(spark, f"{path}/m", keys), keys).collect()) == ["C210", "C211", "broadcast"]


def test_landings_without_partitions_or_key_presence(spark):
    path = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    messages = spark.createDataFrame([("C1", 1, "1.0", "U", "a", None, "1.0"), ("C1", 2, "2.0", "U", "b", None, None)],
                                     "channel_id string, pos long, ts string, user string, text string, subtype string, thread_ts string")
    messages.write.parquet(path)
    keys = spark.createDataFrame([("C1", "2.0")], "channel_id string, key_ts string")
    assert {r.text: r.has_thread for r in chat.read_messages(spark, path, keys).collect()} == {"a": True, "b": False}
