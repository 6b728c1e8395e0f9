"""Scalar functions: Python strip, mention strip, ids, links, keys, distances."""

import math

from pyspark.sql import functions as F

from chatlore import functions as L
from chatlore.config import SMALL_TALK

PY_SPACES = [0x9, 0xA, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
             *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "v string").select(col.alias("r")).first()["r"]


def test_python_whitespace_set_is_the_29_isspace_chars():
    assert len(PY_SPACES) == 29
    assert all(chr(c).isspace() for c in PY_SPACES)


def test_py_strip_matches_python_on_every_space_and_a_control(spark):
    samples = [chr(c) + "x y" + chr(c) for c in PY_SPACES] + ["\x01x\x01", "\u001cx　", "", "  "]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r["r"] for r in df.select(L.py_strip("v").alias("r")).collect()]
    assert got == [s.strip() for s in samples]


def test_mention_strip(spark):
    assert one(spark, L.mention_strip(L.py_strip("v")), "<@U1> a > b") == "a > b"
    assert one(spark, L.mention_strip(L.py_strip("v")), "is a > b?") == "b?"
    assert one(spark, L.mention_strip(L.py_strip("v")), "x") == "x"


def test_small_talk_is_whole_text_only(spark):
    assert one(spark, L.is_small_talk(L.py_strip("v")), " HELLO ") is True
    assert one(spark, L.is_small_talk(L.py_strip("v")), "hi!") is False
    assert set(SMALL_TALK) == {"hi", "hello", "hey", "help", "morning", "ping"}


def test_doc_id_and_permalink(spark):
    df = spark.createDataFrame([("C1", "1713500000.123459")], "c string, ts string")
    r = df.select(L.doc_id("c", "ts").alias("id"), L.permalink("c", "ts").alias("url")).first()
    assert r["id"] == "5ac83f83346a2400430c2822dff038a39728cf8bce64f338465967fe71e80118"
    assert r["url"] == "https://app.slack.com/archives/C1/p1713500000123459"


def test_author_name_cases(spark):
    rows = [(None, False, None), ("", False, None), ("U9", False, None), ("U1", True, ""), ("U2", True, "Ann")]
    df = spark.createDataFrame(rows, "u string, m boolean, n string")
    got = [r[0] for r in df.select(L.author_name("u", "m", "n")).collect()]
    assert got == ["Unknown", "Unknown", "U9", "", "Ann"]


def test_session_keys(spark):
    df = spark.createDataFrame([(None, "1.0", "U1"), ("", "2.0", "U2"), ("9.0", "3.0", "U3")],
                               "th string, ts string, u string")
    got = df.select(L.mention_key("th", "ts").alias("m"), L.dm_key("th", "u").alias("d")).collect()
    assert [(r.m, r.d) for r in got] == [("1.0", "U1"), ("", "U2"), ("9.0", "9.0")]


def test_ts_order_is_numeric(spark):
    df = spark.createDataFrame([("10.5",), ("9.5",)], "ts string")
    assert [r.ts for r in df.orderBy(L.ts_order("ts")).collect()] == ["9.5", "10.5"]


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 5.0])], "a array<double>, b array<double>")
    r = df.select(L.distance("a", "b", "l2sq").alias("l2"), L.distance("a", "b", "cosine").alias("cos"),
                  L.distance("a", "b", "ip").alias("ip")).first()
    assert r.l2 == 8.0
    assert math.isclose(r.cos, 1 - 16 / (math.sqrt(14) * math.sqrt(26)))
    assert r.ip == 1 - 16


def test_response_fields(spark):
    df = spark.createDataFrame([('{"embedding": [1, 2]}', 200), ('{"message": {"content": "hi"}}', 200),
                                ('{"error": "model missing"}', 404), ("Bad Gateway", 502), ('{"detail":"x"}', 500)],
                               "b string, s int")
    rows = df.select(L.embedding_of("b").alias("e"), L.chat_content("b").alias("c"),
                     L.error_of("b", "s").alias("err")).collect()
    assert rows[0].e == [1.0, 2.0]
    assert rows[1].c == "hi"
    assert rows[2].err == "model missing"
    assert rows[3].err == "Bad Gateway"
    assert rows[4].err == '{"detail":"x"}' and rows[0].err is None


def test_malformed_ts_has_no_order(spark):
    df = spark.createDataFrame([("",), ("x",), ("1.5",)], "ts string")
    assert [r[0] is None for r in df.select(L.ts_order("ts")).collect()] == [True, True, False]
