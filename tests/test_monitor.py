"""Alerts on a stream against the batch form and by hand, with restarts, out of order and with batches tried again."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiscope.streaming import events as D
from lexiscope.streaming import monitor as M

START = datetime(2024, 1, 1, 12, 0)
SCHEMA = "key string, ts timestamp, trigger string, delivered boolean"


def at(quarters):
    return START + timedelta(minutes=15 * quarters)


def by_hand(rows):
    """A plain loop over the quarters of each key."""
    out = set()
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        lease, active, recovered = {}, {}, None
        for q in range(0, max(int((r[1] - START).total_seconds() // 900) for r in own) + 20):
            t, fired = at(q), {}
            for r in own:
                if r[1] == t:
                    fired[r[2]] = fired.get(r[2], False) or r[3]
            for name, ok in sorted(fired.items()):
                kind = "held" if name in lease and t - lease[name] < timedelta(hours=1) else "alert" if ok else "failed"
                if kind == "alert":
                    lease[name] = active[name] = t
                out.add((key, t, kind, name, 1))
            if not fired:
                active = {n: a for n, a in active.items() if t - a <= timedelta(hours=2)}
                if active and (recovered is None or t - recovered >= timedelta(hours=1)):
                    out.add((key, t, "recovered", None, len(active)))
                    active, recovered = {}, t
    return out


def some(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("ab"), at(rng.choice([rng.randrange(12), rng.randrange(40), rng.randrange(100)])), rng.choice(["tail", "denied", "blind"]), rng.random() < 0.7) for _ in range(n)]


def drain(query):
    query.awaitTermination(180)
    assert query.exception() is None


def rows_of(df):
    return {tuple(r) for r in df.select("key", "ts", "kind", "trigger", "n").collect()}


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 150), (3, 5)])
def test_batch_alerts(spark, seed, n):
    rows = some(seed, n)
    got = M.alerts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == by_hand(rows) and len(got) == len(set(got))


def test_batch_alerts_of_nothing(spark):
    assert M.alerts(spark.createDataFrame([(None, START, "tail", True), ("a", None, "tail", True), ("a", START, None, True)], SCHEMA)).count() == 0


def test_stream_alerts_with_a_restart(spark, tmp_path):
    """Two files, the second after a restart, each in no order within the allowed lateness; then the batch form over all rows."""
    before = spark.conf.get(M.PROVIDER)
    M.with_rocksdb(spark)
    try:
        rows = sorted(some(7, 90), key=lambda r: (r[1] + timedelta(minutes=random.Random(str(r)).randrange(100)), r))
        end = ("~", at(300), "none", False)
        files = [rows[:45], [*rows[45:], end]]
        path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
        for part in files:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
            source = spark.readStream.schema(SCHEMA).parquet(path)
            drain(M.write_batches(M.alerts_on_stream(source), out, mark))
        got = spark.read.parquet(out).filter("key <> '~'")
        assert rows_of(got) == by_hand(rows) == rows_of(M.alerts(spark.createDataFrame(rows, SCHEMA)))
        assert got.count() == len(rows_of(got))
    finally:
        spark.conf.set(M.PROVIDER, before)


def test_a_batch_that_is_tried_again_writes_no_row_twice(spark, tmp_path):
    """The first try dies after its write and before the stream's commit."""
    df = spark.createDataFrame([(i,) for i in range(20)], "id long")
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("id long").parquet(path)
    tries = []

    def dies(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        tries.append(n)
        raise RuntimeError("lost before the commit")

    query = stream.writeStream.foreachBatch(dies).option("checkpointLocation", mark).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost before the commit"):
        query.awaitTermination(60)
    assert spark.read.parquet(out).count() == 20
    drain(M.write_batches(stream, out, mark))
    assert tries == [0] and sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(20))


def test_expired_quarters_are_deleted(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for hours in (0, 3, 6):
        rows = [(START + timedelta(hours=hours, minutes=15 * i), "production", "free", "completed", 1000, 200, None) for i in range(4)]
        spark.createDataFrame(rows, "ts timestamp, channel string, tier string, outcome string, latency_ms long, status int, sampling string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        drain(M.write_quarters(D.quarter_counts(D.normalize_events(stream)), out, mark))
    left = spark.read.parquet(out)
    newest = left.agg(F.max("quarter")).first()[0]
    assert {r["quarter"] for r in left.collect()} == {q for q in (START + timedelta(hours=h, minutes=15 * i) for h in (0, 3, 6) for i in range(4)) if timedelta(0) <= newest - q <= timedelta(hours=1, minutes=45)}
    assert left.count() == left.select("quarter").distinct().count() and M.quarters_in(spark, out)[0] >= newest.timestamp() - 7200
