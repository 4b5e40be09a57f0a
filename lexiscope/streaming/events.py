"""Event analytics: closed enums, quarter-hour counters, trailing windows, alerts, quotas and funnels.

Every function takes a batch or a streaming DataFrame unless its name or text says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.functions.text import round_half_up as r6

#: The closed enums of an event.
CHANNELS = ("production", "staging")
TIERS = ("free", "byok", "pro")
OUTCOMES = ("completed", "terminal_failed", "number_safety_failed", "entitlement_denied", "entitlement_unavailable", "quota_denied", "service_disabled", "monitor_drop")
LATENCIES = ("<=30s", "30-60s", "60-120s", ">120s")
QUARTER, LATE_S, AHEAD_S = 900, 7200, 900


def closed(c: str, names: tuple[str, ...]) -> Column:
    return F.when(F.col(c).isin(*names), F.col(c)).otherwise("unknown")


def latency_class(ms: Column) -> Column:
    ok = ms.isNotNull() & ~F.isnan(ms.cast("double")) & (ms >= 0)
    return F.when(~ok, "unknown").when(ms <= 30_000, LATENCIES[0]).when(ms <= 60_000, LATENCIES[1]).when(ms <= 120_000, LATENCIES[2]).otherwise(LATENCIES[3])


def status_class(c: Column) -> Column:
    return F.when(c.between(100, 599) & (c == F.floor(c)), F.concat(F.floor(c / 100).cast("string"), F.lit("xx"))).otherwise("unknown")


def normalize_events(df: DataFrame) -> DataFrame:
    """df(ts, channel, tier, outcome, latency_ms, status, sampling, ...) with enums closed (`unknown` else) and latency and status in classes."""
    return df.withColumns({
        "channel": closed("channel", CHANNELS), "tier": closed("tier", TIERS), "outcome": closed("outcome", OUTCOMES), "latency": latency_class(F.col("latency_ms")),
        "status_class": status_class(F.col("status")), "sampling": F.when(F.col("sampling") == "sampled_1_of_20", F.col("sampling")).otherwise("full"),
    }).drop("latency_ms", "status")


def guard_time(df: DataFrame, now: Column) -> DataFrame:
    """Events no older than two hours and at most fifteen minutes ahead of `now`; those without a time go."""
    age = now.cast("double") - F.col("ts").cast("double")
    return df.filter((age <= LATE_S) & (age >= -AHEAD_S))


def in_quarters(df: DataFrame) -> DataFrame:
    """Counts by quarter hour (a window w), channel, tier, outcome and latency; rows of no known channel, tier, outcome or latency are left out."""
    known = df.filter(F.col("channel").isin(*CHANNELS) & F.col("tier").isin(*TIERS) & F.col("outcome").isin(*OUTCOMES) & F.col("latency").isin(*LATENCIES))
    if df.isStreaming:
        known = known.withWatermark("ts", f"{LATE_S} seconds")
    return known.groupBy(F.window("ts", "15 minutes").alias("w"), "channel", "tier", "outcome", "latency").agg(F.count("*").alias("n"))


def quarter_counts(df: DataFrame) -> DataFrame:
    """in_quarters() with the start of each quarter as `quarter`."""
    return in_quarters(df).select(F.col("w.start").alias("quarter"), "channel", "tier", "outcome", "latency", "n")


def trailing(counts: DataFrame, quarters: int, keys: list[str]) -> DataFrame:
    """Batch: at each quarter with counts, the sum over it and the `quarters` before it, which a window of that many quarters overlaps."""
    g = counts.groupBy(*keys, "quarter").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("quarter").cast("long")).rangeBetween(-quarters * QUARTER, 0)
    return g.select(*keys, "quarter", F.sum("n").over(w).alias("n"))


def cells() -> list[Column]:
    """The count of each latency class and outcome."""
    of = lambda c, v, name: F.sum(F.when(F.col(c) == v, F.col("n")).otherwise(0)).alias(name)
    return [of("latency", b, f"l{i}") for i, b in enumerate(LATENCIES)] + [of("outcome", o, o) for o in OUTCOMES]


def snapshot(counts: DataFrame, quarters: int = 2) -> DataFrame:
    """Batch: a row per channel, tier and quarter with the trailing count of each latency class and outcome."""
    g = counts.groupBy("channel", "tier", "quarter").agg(*cells())
    w = Window.partitionBy("channel", "tier").orderBy(F.col("quarter").cast("long")).rangeBetween(-quarters * QUARTER, 0)
    return g.select("channel", "tier", "quarter", *[F.sum(c).over(w).alias(c) for c in (*[f"l{i}" for i in range(4)], *OUTCOMES)])


def over_quarters(df: DataFrame, quarters: int, keys: list[str], sums: list[Column]) -> DataFrame:
    """Stream: normalised events -> keys, quarter and sums over a quarter with counts and the `quarters` before it.

    Two stateful steps: counts by quarter, then windows that slide by a quarter over the time of those. A window
    stands for its last quarter, so one without counts there gives no row. State ends with the watermark of two hours."""
    counts = in_quarters(df).withColumn("at", F.window_time("w"))
    g = counts.groupBy(F.window("at", f"{(quarters + 1) * 15} minutes", "15 minutes").alias("span"), *keys).agg(*sums, F.max("w.start").alias("quarter"))
    last = F.col("quarter").cast("long") == F.col("span.end").cast("long") - QUARTER
    return g.filter(last).drop("span")


def trailing_on_stream(df: DataFrame, quarters: int, keys: list[str]) -> DataFrame:
    """Stream: the rows of trailing() from normalised events."""
    return over_quarters(df, quarters, keys, [F.sum("n").alias("n")]).select(*keys, "quarter", "n")


def snapshot_on_stream(df: DataFrame, quarters: int = 2) -> DataFrame:
    """Stream: the rows of snapshot() from normalised events; histogram_p95() and alert_triggers() take them as they are."""
    names = [*[f"l{i}" for i in range(4)], *OUTCOMES]
    return over_quarters(df, quarters, ["channel", "tier"], cells()).select("channel", "tier", "quarter", *names)


def histogram_p95(df: DataFrame) -> DataFrame:
    """df(l0..l3) with n, the rank of the 95th percentile, its bucket's upper bound and the share above 120 s."""
    n = F.col("l0") + F.col("l1") + F.col("l2") + F.col("l3")
    rank = F.ceil(n * 0.95)
    bound = F.when(n == 0, None).when(F.col("l0") >= rank, "30s").when(F.col("l0") + F.col("l1") >= rank, "60s").when(F.col("l0") + F.col("l1") + F.col("l2") >= rank, "120s").otherwise(">120s")
    return df.withColumns({"n": n, "rank": rank, "bound": bound, "tail": r6(F.coalesce(F.try_divide(F.col("l3").cast("double"), n), F.lit(0.0)), 5)})


def alert_triggers(df: DataFrame) -> DataFrame:
    """A row for each rule that fires on a snapshot with its histogram: trigger, count."""
    denied = F.col("entitlement_denied") + F.col("entitlement_unavailable")
    total = denied + F.col("completed")
    rule = lambda on, name, k: F.when(on, F.struct(F.lit(name).alias("trigger"), k.cast("long").alias("count")))
    fired = F.array_compact(F.array(
        rule(F.col("number_safety_failed") >= 1, "number_safety", F.col("number_safety_failed")), rule((total >= 20) & (denied >= 5), "entitlement_pro", denied),
        rule((F.col("n") >= 10) & (F.col("bound") == ">120s"), "p95_latency", F.col("n")), rule((F.col("n") >= 10) & (F.col("l3") > 0.05 * F.col("n")), "latency_tail", F.col("l3")),
        rule((F.col("n") == 0) | (F.col("monitor_drop") >= 3), "monitor_blind", F.col("monitor_drop")),
    ))
    return df.select("channel", "tier", "quarter", F.inline(fired))


def failure_ratio(df: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """df(channel, tier, outcome, n): whether over half of at least five requests failed; a denied quota is no failure."""
    g = df.groupBy("channel", "tier").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("outcome").isin("completed", "quota_denied"), 0).otherwise(F.col("n"))).alias("failed"))
    return g.withColumn("fires", (F.col("total") >= least) & (F.col("failed") > share * F.col("total")))


def failure_streaks(df: DataFrame, key: str, order: str, failed: Column, least: int = 3) -> DataFrame:
    """Batch: rows of each key in order with the length of the failure streak that ends there, and whether it alerts."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumn("__f", failed).withColumn("__g", F.sum((~F.col("__f")).cast("int")).over(w))
    streak = F.when(F.col("__f"), F.sum(F.col("__f").cast("int")).over(Window.partitionBy(key, "__g").orderBy(order))).otherwise(0)
    return x.withColumn("streak", streak).withColumn("alert", F.col("streak") >= least).drop("__f", "__g")


def cool_down(df: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Batch: df(keys, ts, delivered) with sent: an alert goes out if none with the same keys went out within `seconds` before.

    One that could not be delivered (`delivered` false; no such column: all can) is not sent and keeps no later
    one back. Each decision depends on the one before, but none on what lies `seconds` or more before its
    neighbour: rows of a key are cut into islands there, and an island passes in order through one task."""
    x = df if "delivered" in df.columns else df.withColumn("delivered", F.lit(True))
    order = Window.partitionBy(*keys).orderBy("ts")
    island = "_" * (1 + max(map(len, x.columns))) + "i"  # longer than any name there is
    far = F.coalesce(F.col("ts").cast("double") - F.lag("ts").over(order).cast("double") >= seconds, F.lit(False)).cast("int")
    x = x.withColumn(island, far).withColumn(island, F.sum(island).over(order))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = last = None
        for b in batches:
            sent = []
            for k, t, fine in zip(b[[*keys, island]].itertuples(index=False, name=None), b["ts"], b["delivered"], strict=True):
                if k != current:
                    current, last = k, None
                ok = bool(fine) and (last is None or (t - last).total_seconds() >= seconds)
                if ok:
                    last = t
                sent.append(ok)
            yield b.assign(sent=sent)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    return x.repartition(*keys, island).sortWithinPartitions(*keys, island, "ts").mapInPandas(fold, f"{fields}, sent boolean").select(*df.columns, "sent")


def recovery(ticks: DataFrame, key: str) -> DataFrame:
    """Batch: df(key, ts, n_triggers) -> the quiet ticks that end a spell of alerts at most two hours old."""
    w = Window.partitionBy(key).orderBy("ts")
    last = F.last(F.when(F.col("n_triggers") > 0, F.col("ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = ticks.withColumns({"before": F.lag("n_triggers").over(w), "last_alert": last})
    return x.filter((F.col("n_triggers") == 0) & (F.col("before") > 0) & (F.col("ts").cast("long") - F.col("last_alert").cast("long") <= 7200)).select(key, "ts", "last_alert")


#: Funnel events and what each of their dimensions may say.
_SURFACE, _LANG, _TIER, _MODE = ("hero", "chat"), ("en", "ko", "zh", "ja"), ("free", "pro", "byok"), ("first", "refine")
_INPUT, _LATENCY, _BAND = ("0-99", "100-499", "500-1999", "2000+"), ("<5s", "5-10s", "10-30s", "30s+"), ("failed", "70-79", "80-89", "90-100")
FUNNEL = {
    "Input Started": {"surface": _SURFACE, "lang": _LANG},
    "Rewrite Requested": {"surface": _SURFACE, "lang": _LANG, "tier": _TIER, "mode": _MODE, "inputBucket": _INPUT},
    "Rewrite Completed": {"surface": _SURFACE, "lang": _LANG, "tier": _TIER, "mode": _MODE, "inputBucket": _INPUT, "latencyBucket": _LATENCY, "mpsBand": _BAND, "fidelityBand": _BAND},
    "Rewrite Failed": {"surface": _SURFACE, "lang": _LANG, "tier": _TIER, "mode": _MODE, "inputBucket": _INPUT, "latencyBucket": _LATENCY, "outcome": ("preflight", "stream", "number-safety", "scoring", "floor", "cancelled", "quota", "concurrency", "service", "input", "auth", "unknown")},
    "Result Action": {"action": ("copy", "download", "export", "audit")},
    "Checkout Started": {"surface": ("pricing", "quota"), "lang": _LANG},
    "Tier Selected": {"tier": _TIER, "surface": ("pricing", "controls")},
}


def validate_events(df: DataFrame, schema: dict[str, dict[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """df(name, data map) with valid: a known name with exactly its keys, each with an allowed value."""
    schema = FUNNEL if schema is None else schema
    ok = F.lit(False)
    for name, dims in schema.items():
        keys = F.array(*[F.lit(k) for k in sorted(dims)])
        values = [F.coalesce(F.element_at("data", k).isin(*v), F.lit(False)) for k, v in dims.items()]
        same = (F.size("data") == len(dims)) & (F.array_sort(F.map_keys("data")) == keys)
        for v in values:
            same = same & v
        ok = F.when(F.col("name") == name, same).otherwise(ok)
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def funnel_daily(df: DataFrame, budget: int = 10_000) -> DataFrame:
    """df(ts, name, data) -> day, name, dims (sorted key=value), n, of the first `budget` events of a day in order of time and id."""
    key = F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    x = df.withColumns({"day": F.to_date("ts"), "dims": key}).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= budget)
    return x.groupBy("day", "name", "dims").agg(F.count("*").alias("n"))


def dedup_deliveries(df: DataFrame, id_col: str) -> DataFrame:
    """Each delivery once, by the digest of its id; a stream forgets ids older than its watermark of two hours."""
    x = df.withColumn("digest", F.sha2(F.col(id_col).cast("string"), 256))
    if df.isStreaming:
        return x.withWatermark("ts", f"{LATE_S} seconds").dropDuplicatesWithinWatermark(["digest"])
    return x.dropDuplicates(["digest"])


#: Limits per tier.
LIMITS = {"free": {"day": 20, "hour": 10}, "pro": {"day": 200, "month": 100, "chars": 50_000}}


def quota_decisions(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Batch: df(event_id, ts, tier, subject, chars) with allowed and reason.

    What has no known tier, no limit or no subject is decided by itself and meets no counter. Counters are taken in order of time. Each counts a request unless an earlier limit denied it: day,
    then hour for `free`; day, then month, then characters for `pro`; `byok` has no limit."""
    lim = LIMITS if limits is None else limits
    day, hour, month = F.floor(F.col("ts").cast("long") / 86400), F.floor(F.col("ts").cast("long") / 3600), F.date_format("ts", "yyyy-MM")
    tier, has = F.coalesce("tier", F.lit("")), F.coalesce(F.col("subject") != "", F.lit(False))
    alone = F.when(~tier.isin(*TIERS), "unsupported").when((tier != "byok") & ~has, F.when(tier == "pro", "license").otherwise("address"))
    free = alone.isNotNull() | (tier == "byok")
    decided = df.filter(free).withColumns({"reason": alone}).withColumn("allowed", F.col("reason").isNull()).select(*df.columns, "allowed", "reason")
    x = df.filter(~free).withColumns({"d": day, "h": hour, "m": month})
    run = lambda part, c: F.sum(c).over(Window.partitionBy("tier", "subject", part).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    cap = lambda name: F.when(F.col("tier") == "free", lim["free"].get(name)).when(F.col("tier") == "pro", lim["pro"].get(name))
    over = lambda c, name: F.coalesce(F.col(c) > cap(name), F.lit(False))
    x = x.withColumn("n_day", run("d", F.lit(1))).withColumn("x_day", over("n_day", "day"))
    x = x.withColumn("n_hour", run("h", (~F.col("x_day")).cast("int"))).withColumn("x_hour", ~F.col("x_day") & over("n_hour", "hour"))
    x = x.withColumn("n_month", run("m", (~F.col("x_day")).cast("int"))).withColumn("x_month", ~F.col("x_day") & over("n_month", "month"))
    size = F.when(~F.col("x_day") & ~F.col("x_month") & (F.coalesce("chars", F.lit(0)) > 0), F.col("chars")).otherwise(0)
    x = x.withColumn("n_chars", run("m", size)).withColumn("x_chars", (size > 0) & over("n_chars", "chars"))
    reason = F.when(F.col("x_day"), "daily").when((F.col("tier") == "free") & F.col("x_hour"), "hourly").when((F.col("tier") == "pro") & F.col("x_month"), "monthly").when((F.col("tier") == "pro") & F.col("x_chars"), "characters")
    return x.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).select(*df.columns, "allowed", "reason").unionByName(decided)


def entitlement_counts(counts: DataFrame, tier: str = "pro") -> DataFrame:
    """Trailing counts of one tier: number safety, refusals and their base, dropped monitor events. Batch: from quarter counts. Stream: from normalised events."""
    own = counts.filter(F.col("tier") == tier)
    s = snapshot_on_stream(own, 1) if counts.isStreaming else snapshot(own, 1)
    refused = F.col("entitlement_denied") + F.col("entitlement_unavailable")
    return s.select("channel", "quarter", F.col("number_safety_failed").alias("number_safety"), refused.alias("refused"), (refused + F.col("completed")).alias("total"), F.col("monitor_drop").alias("dropped"))


# --- deliveries and free log text ------------------------------------------------------------

#: The nine fields of an event in their order, with what each may say.
STATUSES = ("1xx", "2xx", "3xx", "4xx", "5xx", "unknown")
FIELDS = {
    "schemaVersion": "v1", "schema": r"(?:[a-z0-9_-]+\.)*web\.v1", "channel": "|".join(CHANNELS), "evidenceClass": "aggregate_only", "tier": "|".join(TIERS), "outcome": "|".join(OUTCOMES),
    "latencyBucket": "|".join((*LATENCIES, "unknown")), "statusClass": "|".join(STATUSES), "sampling": "full|sampled_1_of_20",
}
EVENT = r",?\s*".join(rf"[{{,\s\"']{name}[\"']?\s*:\s*[\"'](?:{values})[\"']\s*" for name, values in FIELDS.items())
#: Fixed value: characters of the longest message that is looked at.
MESSAGE = 65_536


def events_in(message: str | Column) -> Column:
    """The complete events of a log message, as written as JSON or by an inspector; none of a message that is too long."""
    c = F.col(message) if isinstance(message, str) else message
    found = F.regexp_extract_all(c, F.lit(EVENT), F.lit(0))
    return F.when(c.isNull() | (F.char_length(c) > MESSAGE), F.expr("cast(array() as array<string>)")).otherwise(found)


def parse_deliveries(df: DataFrame, now: Column | None = None, body: str = "body") -> DataFrame:
    """df(delivery_id, body) -> delivery_id, pos, message, ts of the entries that hold events.

    A body is a JSON array or lines of JSON. It is rejected whole if it is empty or malformed, if an entry is
    no object, or if one with events has no positive whole number of milliseconds as its timestamp. Entries
    without events need none. With `now`, entries of more than two hours ago or fifteen minutes ahead are dropped."""
    text = F.trim(F.col(body))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    parsed = F.when(F.startswith(text, F.lit("[")), F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")).otherwise(F.transform(lines, lambda x: F.try_parse_json(F.trim(x))))

    def entry(v: Column) -> Column:
        message, time = F.try_variant_get(v, "$.message", "variant"), F.try_variant_get(v, "$.timestamp", "variant")
        said = F.when(F.schema_of_variant(message) == "STRING", F.try_variant_get(message, "$", "string"))
        number = F.when(F.schema_of_variant(time).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(time, "$", "double"))
        whole = F.when((number == F.floor(number)) & (number > 0) & (number < 2.0**53), number.cast("long"))
        return F.struct(F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)).alias("object"), said.alias("message"), whole.alias("ms"), (F.size(events_in(said)) > 0).alias("bears"))

    x = df.select("delivery_id", F.transform(parsed, entry).alias("e"))
    good = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda e: e["object"] & (~e["bears"] | e["ms"].isNotNull()))
    out = x.filter(good).select("delivery_id", F.posexplode("e").alias("pos", "e")).filter("e.bears").select("delivery_id", "pos", "e.message", F.timestamp_millis(F.col("e.ms")).alias("ts"))
    return out if now is None else guard_time(out, now)


def extract_events(df: DataFrame, column: str = "message") -> DataFrame:
    """All events in free text whose nine fields come in their order, each with a value it may have: channel, tier, outcome and latency."""
    x = df.withColumn("__e", F.explode(events_in(column)))
    said = lambda name: F.regexp_extract("__e", rf"[{{,\s\"']{name}[\"']?\s*:\s*[\"']([^\"']*)[\"']", 1)
    return x.select(*[c for c in df.columns if c != column], said("channel").alias("channel"), said("tier").alias("tier"), said("outcome").alias("outcome"), said("latencyBucket").alias("latency"))


def live_counters(counts: DataFrame, now: Column, seconds: int = LATE_S) -> DataFrame:
    """Counters of quarters that ended at most `seconds` ago; what is older has expired."""
    return counts.filter(now.cast("double") - F.col("quarter").cast("double") - QUARTER <= seconds)


# --- keyed state -----------------------------------------------------------------------------


def alerts_with_state(stream: DataFrame, least: int = 3, seconds: int = 3600) -> DataFrame:
    """Stream of df(key, ts, failed) -> key, ts, kind: `alert` when a streak reaches `least` and none went out within `seconds`; `recovered` on the first success after one."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        streak, sent, active = state.get if state.exists else (0, -1, False)
        out = []
        for f in frames:
            for t, bad in sorted(zip(f["ts"], f["failed"], strict=True)):
                now = int(t.timestamp())
                streak = streak + 1 if bad else 0
                if bad and streak >= least and (sent < 0 or now - sent >= seconds):
                    sent, active = now, True
                    out.append((key[0], t, "alert"))
                elif not bad and active:
                    active = False
                    if now - sent <= 7200:
                        out.append((key[0], t, "recovered"))
        state.update((streak, sent, active))
        yield pd.DataFrame(out, columns=["key", "ts", "kind"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, kind string", "streak int, sent long, active boolean", "append", GroupStateTimeout.NoTimeout)


def write_counters(stream: DataFrame, path: str, checkpoint: str):
    """Quarter counts of a stream as Parquet, once each quarter is past the watermark; everything there is, then stop."""
    return quarter_counts(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def score_stream(stream: DataFrame, lexicon: DataFrame, path: str, checkpoint: str, window: int = 50):
    """Paragraph verdicts of arriving documents, a micro-batch at a time."""
    from lexiscope.operators.verdicts import paragraph_verdicts

    def each(batch: DataFrame, n: int) -> None:
        paragraph_verdicts(batch, lexicon, "line", window).withColumn("batch", F.lit(n)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
