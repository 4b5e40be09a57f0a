"""Alerts of a monitored service as keyed state: leases by trigger, recovery by timers, and sinks that can be written again.

One set of rules serves the batch form and the stream. A trigger that fires at a quarter goes out unless one with its name
went out less than an hour before; one that can't be delivered gives its lease back, so the next may go out. The
first quarter at which nothing fires ends a spell: alerts of the last two hours are reported as recovered, at most
once an hour. The stream needs no further event for that: an event-time timer wakes the key at the next quarter.

Times are those of the events, so a replay at any pace, with a restart anywhere, gives the same rows. Timers also
drop what has expired: a key that is at rest keeps no state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lexiscope.session import delete
from lexiscope.streaming.events import LATE_S, QUARTER

LEASE_S, ACTIVE_S = 3600, 7200
OUT = "key string, ts timestamp, kind string, trigger string, n long"


def fire(leases: dict[str, int], active: dict[str, int], ts: int, trigger: str, delivered: bool) -> str:
    """What becomes of a trigger: `alert`, `held` by its lease, or `failed`; leases and active alerts follow."""
    if trigger in leases and ts - leases[trigger] < LEASE_S:
        return "held"
    if not delivered:
        return "failed"
    leases[trigger] = active[trigger] = ts
    return "alert"


def rest(leases: dict[str, int], active: dict[str, int], ts: int, recovered: int | None) -> int:
    """At a quarter without triggers: how many active alerts have recovered, 0 if none or if the last report is too recent. What has expired goes."""
    for held, seconds in ((leases, LEASE_S), (active, ACTIVE_S + 1)):
        for t in [t for t, at in held.items() if ts - at >= seconds]:
            del held[t]
    n = len(active)
    if not n or recovered is not None and ts - recovered < LEASE_S:
        return 0
    active.clear()
    return n


class Desk:
    """The state of one key, and what a quarter makes of it."""

    def __init__(self, leases: dict[str, int] | None = None, active: dict[str, int] | None = None, recovered: int | None = None):
        self.leases, self.active, self.recovered = leases or {}, active or {}, recovered

    def quarter(self, ts: int, fired: list[tuple[str, bool]]) -> list[tuple[int, str, str | None, int]]:
        """(ts, kind, trigger, n) of a quarter; fired: the triggers, each with whether it can be delivered."""
        if fired:
            return [(ts, fire(self.leases, self.active, ts, t, bool(ok)), t, 1) for t, ok in sorted(fired)]
        n = rest(self.leases, self.active, ts, self.recovered)
        if n:
            self.recovered = ts
        return [(ts, "recovered", None, n)] if n else []

    def next(self, ts: int) -> int | None:
        """The quarter at which to look again if nothing fires until then; None once all has expired."""
        return ts + QUARTER if self.active or self.leases or self.recovered is not None and ts - self.recovered < LEASE_S else None


def frame(key: str, rows: list[tuple[int, str, str | None, int]]) -> pd.DataFrame:
    said = lambda values: pd.Series(values, dtype=object)
    times = pd.Series([datetime.fromtimestamp(r[0], UTC).replace(tzinfo=None) for r in rows], dtype="datetime64[ns]")
    return pd.DataFrame({"key": said([key] * len(rows)), "ts": times, "kind": said([r[1] for r in rows]), "trigger": said([r[2] for r in rows]), "n": pd.Series([r[3] for r in rows], dtype="int64")})


# --- batch -----------------------------------------------------------------------------------


def alerts(triggers: DataFrame) -> DataFrame:
    """Batch: triggers(key, ts, trigger, delivered) -> key, ts, kind (alert, held, failed or recovered), trigger, n.

    ts is a whole quarter; repeated triggers of a quarter count once, as delivered if one of them was. Quarters of a key that lie
    three hours or more apart share no lease, no active alert and no report, so they are independent and pass through different tasks."""
    from pyspark.sql import Window

    apart = LEASE_S + ACTIVE_S
    once = triggers.filter("key is not null and trigger is not null and ts is not null").groupBy("key", "ts", "trigger").agg(F.max(F.coalesce("delivered", F.lit(False))).alias("delivered"))
    quarters = once.groupBy("key", F.col("ts").cast("long").alias("s")).agg(F.collect_list(F.struct("trigger", "delivered")).alias("fired"))
    order = Window.partitionBy("key").orderBy("s")
    islands = quarters.withColumn("new", (F.col("s") - F.lag("s").over(order) > apart).cast("int")).withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, desk, wake, last = None, Desk(), None, 0

        def idle(until: int | None) -> list:
            nonlocal wake
            out = []
            while wake is not None and (until is None or wake < until):
                out += desk.quarter(wake, [])
                wake = desk.next(wake)
            return out

        for b in batches:
            for key, island, s, fired in zip(b["key"], b["island"], b["s"], b["fired"], strict=True):
                if (key, island) != current:
                    if current is not None:
                        yield frame(current[0], idle(None))
                    current, desk, wake = (key, island), Desk(), None
                out = idle(s) + desk.quarter(s, [(f["trigger"], f["delivered"]) for f in fired])
                wake = desk.next(s)
                yield frame(key, out)
        if current is not None:
            yield frame(current[0], idle(None))

    return islands.select("key", "island", "s", "fired").repartition("key", "island").sortWithinPartitions("key", "island", "s").mapInPandas(run, OUT)


# --- stream ----------------------------------------------------------------------------------


class Monitor(StatefulProcessor):
    """Alerts of one key. Triggers wait in a map by their quarter until the watermark has passed it, so that they are
    taken in the order of time whatever the order they came in."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "s long", "fired string")
        self.leases = handle.getMapState("leases", "trigger string", "s long")
        self.active = handle.getMapState("active", "trigger string", "s long")
        self.recovered = handle.getValueState("recovered", "s long")
        self.read: dict[tuple, tuple[Desk, dict[int, dict[str, bool]]]] = {}  # of this task; every change is written through

    def of(self, key: tuple) -> tuple[Desk, dict[int, dict[str, bool]]]:
        """The desk of a key and its waiting triggers by quarter, read once for a task."""
        if key not in self.read:
            held = [{k[0]: v[0] for k, v in m.iterator()} for m in (self.leases, self.active, self.waiting)]
            desk = Desk(held[0], held[1], self.recovered.get()[0] if self.recovered.exists() else None)
            self.read[key] = desk, {s: json.loads(fired) for s, fired in held[2].items()}
        return self.read[key]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, came = self.of(key)[1], set()
        for b in rows:
            for t, trigger, ok in zip(b["ts"], b["trigger"], b["delivered"], strict=True):
                if trigger is not None:
                    s = int(t.timestamp())
                    fired = waiting.setdefault(s, {})
                    fired[trigger] = fired.get(trigger, False) or bool(ok)
                    came.add(s)
        for s in came:
            self.waiting.updateValue((s,), (json.dumps(waiting[s]),))
            self.handle.registerTimer(s * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = expiredTimerInfo.getExpiryTimeInMs() // 1000
        now = timerValues.getCurrentWatermarkInMs() // 1000
        desk, waiting = self.of(key)
        held, recovered = [dict(desk.leases), dict(desk.active)], desk.recovered
        fired = waiting.pop(s, {})
        if fired:
            self.waiting.removeKey((s,))
        out = desk.quarter(s, list(fired.items()))
        # quiet quarters that the watermark has passed already: a timer that is set for one now would wait for the next batch
        until = min([now + 1, *waiting])
        wake = desk.next(s)
        while wake is not None and wake < until:
            out += desk.quarter(wake, [])
            wake = desk.next(wake)
        if wake is None:
            desk.recovered = None
        elif wake not in waiting:
            self.handle.registerTimer(wake * 1000)
        for state, old, new in ((self.leases, held[0], desk.leases), (self.active, held[1], desk.active)):
            for t in old.keys() - new.keys():
                state.removeKey((t,))
            for t in new:
                if old.get(t) != new[t]:
                    state.updateValue((t,), (new[t],))
        if desk.recovered is None and recovered is not None:
            self.recovered.clear()
        elif desk.recovered != recovered:
            self.recovered.update((desk.recovered,))
        if out:
            yield frame(key[0], out)

    def close(self) -> None:
        pass


def alerts_on_stream(triggers: DataFrame, late: int = LATE_S) -> DataFrame:
    """Stream: the rows of alerts() from a stream of triggers(key, ts, trigger, delivered), each once the watermark of `late` seconds has passed its quarter.

    State lies in RocksDB, by key and trigger; the session must have that provider (see with_rocksdb)."""
    x = triggers.filter("key is not null and ts is not null").select("key", "ts", "trigger", F.coalesce("delivered", F.lit(False)).alias("delivered"))
    return x.withWatermark("ts", f"{late} seconds").groupBy("key").transformWithStateInPandas(statefulProcessor=Monitor(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocksdb(spark) -> None:
    """Let keyed state of this session's new streams lie in RocksDB, which map state and timers need."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- sinks -----------------------------------------------------------------------------------


def write_batches(stream: DataFrame, path: str, checkpoint: str, change=None):
    """Every micro-batch in a folder of its own, named by its number: a batch that is tried again replaces what it had written, so each row is there once.

    `change` is applied to each batch. Everything there is, then stop."""

    def each(batch: DataFrame, n: int) -> None:
        (batch if change is None else change(batch)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_quarters(counts: DataFrame, path: str, checkpoint: str, keep: int = LATE_S):
    """Counts by quarter in a folder for each quarter and micro-batch; quarters that ended more than `keep` seconds before the newest are deleted.

    A batch that is tried again writes the same folders. What is deleted is named by its quarter alone, so deleting it again does no harm."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        s = F.col("quarter").cast("long")
        batch.withColumns({"s": s, "batch": F.lit(n)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("s", "batch").parquet(path)
        found = quarters_in(spark, path)
        for old in [q for q in found if max(found) - q - QUARTER > keep]:
            delete(spark, f"{path}/s={old}")

    return counts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarters_in(spark, path: str) -> list[int]:
    """The quarters that a folder of write_quarters() holds: some hours' worth, whatever the stream."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[2:]) for n in names if n.startswith("s="))
