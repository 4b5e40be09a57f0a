"""Streams from files, run to their end, against the batch form or by hand."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiscope.streaming import events as D

START = datetime(2024, 1, 1, 12, 0)
EVENT = dict(schemaVersion="v1", schema="web.v1", channel="production", evidenceClass="aggregate_only", tier="pro", outcome="completed", latencyBucket="<=30s", statusClass="2xx", sampling="full")


def at(minutes):
    return START + timedelta(minutes=minutes)


def stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def events(spark):
    rows = [(at(i * 3), "production", "free" if i % 2 else "pro", "completed", i * 9000, 200 + i, None) for i in range(40)]
    return spark.createDataFrame(rows, "ts timestamp, channel string, tier string, outcome string, latency_ms long, status int, sampling string")


def test_quarter_counts(spark, tmp_path):
    df = events(spark)
    s = D.normalize_events(stream(spark, df, str(tmp_path / "in")))
    drain(D.write_counters(s, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in D.quarter_counts(D.normalize_events(df)).collect()}
    # the stream keeps open what the watermark of two hours has not passed
    assert got <= want and all(r[0] < at(39 * 3) - timedelta(hours=2) for r in got)


def test_deliveries_once(spark, tmp_path):
    df = spark.createDataFrame([(at(i), f"d{i % 3}") for i in range(9)], "ts timestamp, id string")
    q = D.dedup_deliveries(stream(spark, df, str(tmp_path / "in")), "id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(q)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["d0", "d1", "d2"]
    assert D.dedup_deliveries(df, "id").count() == 3


def test_alert_state(spark, tmp_path):
    flags = [1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0]
    df = spark.createDataFrame([("k", at(i * 15), bool(f)) for i, f in enumerate(flags)], "key string, ts timestamp, failed boolean")
    q = D.alerts_with_state(stream(spark, df, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(q)
    got = [(r["kind"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()]
    assert got == [("alert", at(5 * 15)), ("alert", at(9 * 15)), ("recovered", at(10 * 15))]


def test_score_stream(spark, tmp_path):
    from lexiscope.operators.verdicts import paragraph_verdicts

    text = "One two three four. Five six seven eight. Nine ten eleven twelve.\nOther line here"
    df = spark.createDataFrame([(i, text, "en", "s") for i in range(3)], "doc_id long, text string, lang string, source string")
    lex = spark.createDataFrame([("en", "strict", "seven")], "lang string, kind string, entry string")
    drain(D.score_stream(stream(spark, df, str(tmp_path / "in")), lex, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()}
    assert got == {tuple(r) for r in paragraph_verdicts(df, lex, "line").collect()} and len(got) == 6


def test_streaks_and_cool_down(spark):
    df = spark.createDataFrame([("k", at(i * 15), bool(f)) for i, f in enumerate([1, 1, 0, 1, 1, 1])], "key string, ts timestamp, failed boolean")
    last = D.failure_streaks(df, "key", "ts", F.col("failed")).orderBy(F.desc("ts")).first()
    assert (last["streak"], last["alert"]) == (3, True)
    alerts = spark.createDataFrame([(k, at(m)) for k in "ab" for m in (0, 15, 59, 60, 61, 200)], "key string, ts timestamp")
    assert sorted((r["key"], r["ts"]) for r in D.cool_down(alerts, ["key"]).filter("sent").collect()) == [(k, at(m)) for k in "ab" for m in (0, 60, 200)]
    failing = spark.createDataFrame([("a", t, at(m), ok) for t in "xy" for m, ok in ((0, t == "x"), (15, True), (30, True), (80, True))], "key string, trigger string, ts timestamp, delivered boolean")
    got = sorted((r["trigger"], r["ts"]) for r in D.cool_down(failing, ["key", "trigger"]).filter("sent").collect())
    assert got == [("x", at(0)), ("x", at(80)), ("y", at(15)), ("y", at(80))]


def test_time_guard(spark):
    df = spark.createDataFrame([(at(-120.1),), (at(-119),), (at(14),), (at(16),), (None,)], "ts timestamp")
    assert [r["ts"] for r in D.guard_time(df, F.lit(START)).orderBy("ts").collect()] == [at(-119), at(14)]


def test_histogram(spark):
    r = D.histogram_p95(spark.createDataFrame([(18, 1, 0, 1)], "l0 long, l1 long, l2 long, l3 long")).first()
    assert (r["n"], r["rank"], r["bound"], r["tail"]) == (20, 19, "60s", 0.05)


def test_quota(spark):
    rows = [(i, at(i), "free", "s", 10) for i in range(11)] + [(20, START, "byok", None, 1), (21, START, "free", "", 1), (22, START, "gold", "s", 1)]
    rows += [(30 + i, at(i), "pro", "p", 20_000) for i in range(4)]
    got = {r["event_id"]: r["reason"] for r in D.quota_decisions(spark.createDataFrame(rows, "event_id long, ts timestamp, tier string, subject string, chars long")).collect()}
    assert got[9] is None and got[10] == "hourly" and got[20] is None and got[21] == "address" and got[22] == "unsupported"
    assert [got[30 + i] for i in range(4)] == [None, None, "characters", "characters"]


def test_deliveries_of_logs(spark):
    ms = 1704110400000
    entry = lambda t=ms, **more: json.dumps({"message": "x " + json.dumps(EVENT | more) + " y", "timestamp": t})
    good, plain = entry(), json.dumps({"message": "no event here"})
    rows = {
        1: f"[{good}, {good}]", 2: f"{good}\n\n{plain}\n{good}", 3: f"{good}\nnot json", 4: '[{"message": "m"}]', 5: "", 6: f"[{entry(-5)}]", 7: f"[{good}, 3]", 8: f"[{good}, {entry(None)}]",
        9: f"[{entry(1.5)}]", 10: entry(str(ms)), 11: json.dumps({"timestamp": ms}), 12: f"{{}}\n{good}", 13: entry(ms - 8_000_000), 14: json.dumps([json.loads(good), {"message": 7, "timestamp": None}]),
    }
    df = spark.createDataFrame(list(rows.items()), "delivery_id int, body string")
    parsed = D.parse_deliveries(df)
    assert sorted((r["delivery_id"], r["pos"]) for r in parsed.collect()) == [(1, 0), (1, 1), (2, 0), (2, 2), (12, 1), (13, 0), (14, 0)]
    assert {r["delivery_id"] for r in D.parse_deliveries(df, F.timestamp_millis(F.lit(ms))).collect()} == {1, 2, 12, 14}
    out = D.extract_events(parsed).collect()
    assert len(out) == 7 and {(r["channel"], r["tier"], r["outcome"], r["latency"]) for r in out} == {("production", "pro", "completed", "<=30s")}


@pytest.mark.parametrize("change", [{"tier": "gold"}, {"schemaVersion": "v9"}, {"evidenceClass": "raw_text"}, {"statusClass": "9xx"}, {"sampling": "half"}, {"latencyBucket": "5s"}, {"channel": "dev"}, {"outcome": "fine"}])
def test_events_have_closed_fields(spark, change):
    bad = spark.createDataFrame([(json.dumps(EVENT | change),)], "message string")
    assert D.extract_events(bad).count() == 0


def test_events_as_an_inspector_writes_them(spark):
    text = "{\n  " + ",\n  ".join(f"{k}: '{v}'" for k, v in EVENT.items()) + "\n}"
    missing = json.dumps({k: v for k, v in EVENT.items() if k != "sampling"})
    swapped = json.dumps(dict(sorted(EVENT.items())))
    df = spark.createDataFrame([(1, text), (2, missing), (3, swapped), (4, None), (5, json.dumps(EVENT) * 2), (6, "x" * 70_000 + json.dumps(EVENT))], "id int, message string")
    assert sorted(r["id"] for r in D.extract_events(df).collect()) == [1, 5, 5]


def test_counters_expire(spark):
    df = spark.createDataFrame([(at(m),) for m in (0, -120, -135, -136)], "quarter timestamp")
    assert D.live_counters(df, F.lit(START)).count() == 3


def test_funnel(spark):
    rows = [("Input Started", {"surface": "hero", "lang": "en"}), ("Input Started", {"surface": "hero"}), ("Input Started", {"surface": "hero", "lang": "xx"}), ("Input Started", {"surface": "hero", "lang": "en", "more": "1"}), ("Other", {"surface": "hero", "lang": "en"}), (None, None)]
    df = spark.createDataFrame(rows, "name string, data map<string,string>")
    assert [r["valid"] for r in D.validate_events(df).collect()] == [True, False, False, False, False, False]
