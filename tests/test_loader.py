"""Loader edge rows (FIXTURES.md section 3) and stitch properties."""

from pyspark.sql import functions as F

from chatlore import schemas
from chatlore.config import Params
from chatlore.operators import documents as D
from chatlore.operators import messages as M
from chatlore.operators import stitch
from chatlore.sources import chat

USERS = [("U1", "Ann"), ("U2", ""), ("U3", None)]


def msgs(spark, rows):
    return spark.createDataFrame(rows, schemas.MESSAGES)


def reps(spark, rows):
    return spark.createDataFrame(rows, schemas.REPLIES)


def users(spark):
    return spark.createDataFrame(USERS, schemas.USERS)


def load(spark, m, r=(), params=Params(), **kw):
    return {d["metadata"]["timestamp"]: d for d in
            D.load_documents(msgs(spark, m), reps(spark, list(r)), users(spark), params, **kw).collect()}


def test_subtype_filter(spark):
    docs = load(spark, [("C", 0, "3.0", "U1", "a", None, None), ("C", 1, "2.0", "U1", "b", "", None),
                        ("C", 2, "1.0", "U1", "c", "bot_message", None)])
    assert sorted(docs) == ["2.0", "3.0"]


def test_thread_stitch_order_names_and_defaults(spark):
    m = [("C", 0, "10.0", "U1", "p", None, "10.0")]
    r = [("C", "10.0", "10.0", "U1", "p"), ("C", "10.0", "10.5", "U1", "a"), ("C", "10.0", "9.9", None, "z"),
         ("C", "10.0", "11.0", None, "b")]
    # ts 9.9 sorts first numerically, so it is the skipped first element
    docs = load(spark, m, r)
    assert docs["10.0"]["text"] == "p\n\n[Reply from Ann]: p\n\n[Reply from Ann]: a\n\n[Reply from Unknown]: b"


def test_fixture_thread(spark):
    m = [("C", 0, "1.0", "U1", "p", None, "1.0")]
    r = [("C", "1.0", "1.0", "U1", "p"), ("C", "1.0", "1.1", "U1", "a"), ("C", "1.0", "1.2", None, "b")]
    assert load(spark, m, r)["1.0"]["text"] == "p\n\n[Reply from Ann]: a\n\n[Reply from Unknown]: b"


def test_no_thread_and_parent_only_keep_text(spark):
    m = [("C", 0, "1.0", "U1", "x", None, None), ("C", 1, "2.0", "U1", "y", None, "2.0")]
    r = [("C", "2.0", "2.0", "U1", "y")]
    docs = load(spark, m, r)
    assert docs["1.0"]["text"] == "x" and docs["2.0"]["text"] == "y"


def test_null_reply_text_renders_empty_and_missing_parent_text_is_empty(spark):
    m = [("C", 0, "1.0", "U1", None, None, "1.0")]
    r = [("C", "1.0", "1.0", "U1", None), ("C", "1.0", "1.1", "U2", None)]
    assert load(spark, m, r)["1.0"]["text"] == "\n\n[Reply from ]: "


def test_authors(spark):
    m = [("C", 0, "1.0", None, "a", None, None), ("C", 1, "2.0", "", "b", None, None),
         ("C", 2, "3.0", "U9", "c", None, None), ("C", 3, "4.0", "U2", "d", None, None)]
    docs = load(spark, m)
    assert [docs[t]["metadata"]["author"] for t in ("1.0", "2.0", "3.0", "4.0")] == ["Unknown", "Unknown", "U9", ""]


def test_metadata_and_id(spark):
    d = load(spark, [("C1", 0, "1713500000.123459", "U1", "t", None, None)])["1713500000.123459"]
    assert d["id"] == "5ac83f83346a2400430c2822dff038a39728cf8bce64f338465967fe71e80118"
    assert d["metadata"]["slack_url"] == "https://app.slack.com/archives/C1/p1713500000123459"
    assert d["metadata"]["channel_id"] == "C1"


def test_truncate_at_error_keeps_earlier_documents(spark):
    m = [("C", i, None if i == 2 else f"{10 - i}.0", "U1", f"m{i}", None, None) for i in range(5)]
    kept = load(spark, m, on_error="truncate")
    assert sorted(kept) == ["10.0", "9.0"]
    skipped = load(spark, m)
    assert len(skipped) == 4
    assert M.load_errors(msgs(spark, m)).count() == 1


def test_cap_counts_system_messages(spark):
    m = [("C", i, f"{1000 + i}.0", "U1", "t", "channel_join" if i >= 190 else None, None) for i in range(200)]
    docs = load(spark, m, params=Params(history_cap=100))
    assert len(docs) == 90
    assert min(float(t) for t in docs) == 1100.0


def test_targets(spark):
    m = [("A", 0, "1.0", "U1", "a", None, None), ("B", 0, "2.0", "U1", "b", None, None)]
    assert sorted(load(spark, m, params=Params(targets=("B",)))) == ["2.0"]
    targets = spark.createDataFrame([("A",)], "channel_id string")
    got = M.select_targets(msgs(spark, m), targets).collect()
    assert [r.channel_id for r in got] == ["A"]


def test_hot_thread_split_over_buckets_equals_one_bucket(spark):
    rows = [("C", "0.0", f"{i}.{i % 7:06d}", f"U{i % 3 + 1}", f"r{i}") for i in range(3000)]
    df = reps(spark, rows).withColumn("name", F.col("user"))
    one = stitch.stitch(df, "name", bucket_seconds=10 ** 9).first()["replies_text"]
    many = stitch.stitch(df, "name", bucket_seconds=7).first()["replies_text"]
    levels = stitch.stitch(df, "name", bucket_seconds=(1, 7, 98)).first()["replies_text"]
    default = stitch.stitch(df, "name").first()["replies_text"]
    assert one == many == levels == default
    assert many.startswith("\n\n[Reply from U2]: r1\n\n") and many.count("[Reply from") == 2999


def test_json_landing_key_presence(spark):
    raw = spark.createDataFrame([
        ("C", 0, '{"ts": "1.0", "user": "U1", "thread_ts": null}'),
        ("C", 1, '{"ts": "2.0", "user": "U1", "text": null}'),
        ("C", 2, '{"ts": "3.0", "user": "U1"}'),
    ], "channel_id string, pos long, body string")
    parsed = {r.ts: r for r in chat.parse_raw_messages(raw).collect()}
    assert parsed["1.0"].has_thread is True and parsed["3.0"].has_thread is False
    assert parsed["2.0"].text is None and parsed["3.0"].text == ""


def test_cap_plans_as_window_group_limit(spark):
    m = msgs(spark, [("C", 0, "1.0", "U1", "a", None, None)])
    plan = M.recent_cap(m, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_reply_cap_keeps_first_page(spark):
    m = [("C", 0, "1.0", "U1", "p", None, "1.0")]
    r = [("C", "1.0", "1.0", "U1", "p")] + [("C", "1.0", f"1.{i}", "U1", f"r{i}") for i in range(1, 6)]
    docs = load(spark, m, r, params=Params(reply_cap=3))
    assert docs["1.0"]["text"] == "p\n\n[Reply from Ann]: r1\n\n[Reply from Ann]: r2"
