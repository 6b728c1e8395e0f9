"""Exports through the data source: rows of ``read_export``, partitions, pieces, unreadable files."""

from __future__ import annotations

import json
import os
import random
import uuid

import pytest

from chatlore.session import scratch_path
from chatlore.sources import chat, export_source
from chatlore.sources.export_source import ExportReader, objects, read_export_days, write_export

HARD = [{"ts": "1.000001", "text": 'a "quoted" \\ {brace} [x] é 😀\n'}, {"ts": "2.000000", "text": None, "thread_ts": None},
        {"ts": "3.000000", "thread_ts": "3.000000", "text": "parent", "files": [{"id": 1, "tags": ["]", "}"]}]},
        {"ts": "4.000000", "thread_ts": "3.000000", "user": "U1", "text": "reply"}, {"ts": "5.000000"}]


def export(spark, files):
    root = scratch_path(spark, f"export-{uuid.uuid4().hex}").replace("file:", "")
    for (channel, day), body in files.items():
        os.makedirs(f"{root}/{channel}", exist_ok=True)
        with open(f"{root}/{channel}/{day}", "w", encoding="utf-8") as fh:
            fh.write(body)
    return root


def test_objects_whatever_the_pieces():
    r = random.Random(4)
    for text in (json.dumps(HARD), json.dumps(HARD, indent=2, ensure_ascii=False)):
        for _ in range(40):
            cuts = sorted(r.randrange(len(text)) for _ in range(r.randrange(30)))
            pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            assert [json.loads(x) for x in objects(iter(pieces))] == HARD
    assert [*objects(iter([" [ ", "] "]))] == [] and [*objects(iter([]))] == []
    for bad in ('{"a": 1}', "[1]", '[{"a": 1}', '[{"a": 1} {"b": 2}]', '[{"a" 1}]', "[{}], 3"):
        with pytest.raises(ValueError):
            [*objects(iter(bad))]


def test_rows_of_read_export_and_a_partition_per_day(spark):
    files = {(c, f"2024-01-0{d}.json"): json.dumps(HARD[: d + 2]) for c in ("C1", "C2") for d in (1, 2, 3)}
    root = export(spark, {**files, ("C3", "2024-01-01.json"): "[]", ("C3", "notes.txt"): "x"})
    for got, want in zip(read_export_days(spark, root), chat.read_export(spark, root), strict=True):
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 5
    days = ExportReader({"path": root}).partitions()
    assert len(days) == 7 and len({(d.channel, d.day) for d in days}) == 7
    assert read_export_days(spark, root)[0].rdd.getNumPartitions() == 7
    some = ExportReader({"path": root, "channels": '["C2"]', "days": '["2024-01-01", "2024-01-03"]'}).partitions()
    assert [(d.channel, d.day) for d in some] == [("C2", "2024-01-01"), ("C2", "2024-01-03")]
    assert read_export_days(spark, root, channels=["C9"])[0].count() == 0


def test_a_file_that_is_no_array_is_named(spark):
    root = export(spark, {("C1", "2024-01-01.json"): json.dumps(HARD), ("C1", "2024-01-02.json"): '[{"ts": "1.0"}'})
    assert read_export_days(spark, root, days=["2024-01-01"])[0].count() == 3
    with pytest.raises(Exception, match="2024-01-02.json"):
        read_export_days(spark, root)[0].collect()


def test_write_export_keeps_key_presence(spark):
    root = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    raw = spark.createDataFrame([("C1", 0, json.dumps(b)) for b in HARD] + [("C2", 0, '{"text": "no ts"}')], "channel_id string, pos long, body string")
    write_export(chat.parse_raw_messages(raw), root)
    top, replies = read_export_days(spark, root)
    assert {(r.ts, r.has_thread, r.text) for r in top.collect()} == {
        ("1.000001", False, HARD[0]["text"]), ("3.000000", True, "parent"), ("5.000000", False, ""), (None, False, "no ts")}
    assert replies.count() == 2
    assert sorted(os.listdir(export_source._file_system(root)[1] + "/C2")) == ["none.json"]
