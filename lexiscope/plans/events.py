"""Queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.plans import sql as Q
from lexiscope.session import shared_dir, table
from lexiscope.streaming import events as D
from lexiscope.streaming import monitor as M

OUTCOME = {"click": "completed", "view": "completed", "purchase": "entitlement_denied", "signup": "quota_denied", "error": "terminal_failed"}


def ev(spark, d):
    """The table has wall-clock times; windows and ages need instants, read in the session's time zone."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def wall(f):
    """Times of the result as wall-clock times again."""

    def run(spark, d):
        out = f(spark, d)
        return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in out.dtypes if t == "timestamp"})

    return run


def raw(spark, d, e=None):
    """The event table (or a stream of its rows) in the shape of web events: the type gives the outcome, the value the latency, the user the tier."""
    e = ev(spark, d) if e is None else e
    return e.select(
        "event_id", "ts", "user_id", F.when(F.col("user_id") % 7 == 0, "staging").when(F.col("user_id") % 7 == 1, "elsewhere").otherwise("production").alias("channel"),
        F.element_at(F.array(F.lit("free"), F.lit("byok"), F.lit("pro"), F.lit("trial")), (F.col("user_id") % 4 + 1).cast("int")).alias("tier"),
        F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in OUTCOME.items()]).alias("outcome"), (F.col("value") * 4000).alias("latency_ms"),
        (F.lit(100) + F.col("event_id") % 600).alias("status"), F.when(F.col("event_id") % 3 == 0, "sampled_1_of_20").alias("sampling"),
    )


def counts(spark, d):
    return D.quarter_counts(D.normalize_events(raw(spark, d)))


def hist(spark, d):
    return D.histogram_p95(D.snapshot(counts(spark, d), 16))


def funnel(spark, d):
    e = ev(spark, d)
    lang = F.element_at(F.array(F.lit("en"), F.lit("ko"), F.lit("xx")), (F.col("user_id") % 3 + 1).cast("int"))
    data = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("surface"), F.lit("hero"))).otherwise(F.create_map(F.lit("surface"), F.lit("chat"), F.lit("lang"), lang))
    return e.select("event_id", "ts", F.when(F.col("event_type") == "click", "Input Started").otherwise(F.initcap("event_type")).alias("name"), data.alias("data"))


def quota(spark, d):
    x = raw(spark, d)
    day = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("ts").cast("long") / 86400 - 19723) * 86400 + F.col("event_id") % 7000)
    x = x.select("event_id", day.alias("ts"), "tier", F.concat(F.lit("s"), F.col("user_id") % 5).alias("subject"), (F.col("event_id") % 900).alias("chars"))
    return D.quota_decisions(x).groupBy("tier", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def ticks(spark, d):
    """Quarter ticks of each channel and tier with how many rules fired; every tick has a row."""
    h = hist(spark, d)
    fired = D.alert_triggers(h).groupBy("channel", "tier", "quarter").agg(F.count("*").alias("k"))
    j = h.select("channel", "tier", "quarter").join(fired, ["channel", "tier", "quarter"], "left")
    return j.select(F.concat_ws("/", "channel", "tier").alias("key"), F.col("quarter").alias("ts"), F.coalesce("k", F.lit(0)).alias("n_triggers"))


def replayed(spark, rows, end, query):
    """What a stream over rows(ts, ...) writes in two runs, with a restart between: the earlier half of the time comes first.

    end: the values of a last row, a day after all others, which lets the watermark pass them."""
    ends = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    source, out, mark = (shared_dir(spark) for _ in range(3))
    middle = ends["low"] and ends["low"] + (ends["high"] - ends["low"]) / 2
    last = rows.limit(1).withColumns({"ts": F.lit(ends["high"]) + F.expr("interval 1 day")} | {c: F.lit(v).cast(dict(rows.dtypes)[c]) for c, v in end.items()})
    for part in (rows.filter(F.col("ts") <= F.lit(middle)), rows.filter(F.col("ts") > F.lit(middle)).unionByName(last)):
        part.write.mode("append").parquet(source)
        M.write_batches(query(spark.readStream.schema(rows.schema).parquet(source)), out, mark).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def over_stream(spark, d, query):
    """The result of a query over the stream of events."""
    last = {"event_id": -1, "user_id": 2, "event_type": "click", "value": 1}  # of a known channel and tier, as a filter may come before the watermark
    return replayed(spark, ev(spark, d), last, lambda e: query(D.normalize_events(raw(spark, d, e))))


def fired(spark, d):
    """The rules that fire at a quarter, of which every fifth count can't be delivered."""
    x = D.alert_triggers(hist(spark, d))
    return x.select(F.concat_ws("/", "channel", "tier").alias("key"), F.col("quarter").alias("ts"), "trigger", (F.col("count") % 5 != 0).alias("delivered"))


def alert_stream(spark, d):
    M.with_rocksdb(spark)
    return replayed(spark, fired(spark, d), {"key": "~"}, M.alerts_on_stream)


QUERIES = {
    "d1_normalize_events": lambda s, d: D.normalize_events(raw(s, d)).groupBy("channel", "tier", "outcome", "latency", "status_class", "sampling").agg(F.count("*").alias("n")),
    "d2_quarter_counts": counts,
    "d3_trailing": lambda s, d: D.trailing(counts(s, d), 2, ["channel", "tier", "outcome"]),
    "d4_guard_time": lambda s, d: D.guard_time(ev(s, d), F.to_timestamp(F.lit("2024-01-15 12:00:00"))).select("event_id", "ts"),
    "d5_histogram_p95": lambda s, d: hist(s, d).select("channel", "tier", "quarter", "n", "rank", "bound", "tail"),
    "d6_alert_triggers": lambda s, d: D.alert_triggers(hist(s, d)),
    "d7_failure_streaks": lambda s, d: D.failure_streaks(ev(s, d), "user_id", "event_id", F.col("event_type").isin("error", "signup"), 2).filter("streak > 0").select("event_id", "user_id", "streak", "alert"),
    "d8_cool_down": lambda s, d: D.cool_down(D.alert_triggers(hist(s, d)).withColumnRenamed("quarter", "ts").withColumn("delivered", F.col("count") % 5 != 0), ["channel", "tier", "trigger"]),
    "d9_recovery": lambda s, d: D.recovery(ticks(s, d), "key"),
    "d10_failure_ratio": lambda s, d: D.failure_ratio(counts(s, d)),
    "d11_funnel_daily": lambda s, d: D.funnel_daily(funnel(s, d), 20),
    "d12_dedup_deliveries": lambda s, d: D.dedup_deliveries(ev(s, d).select((F.col("event_id") % 1000).alias("id"), "event_type"), "id").groupBy(F.substring("digest", 1, 1).alias("d")).agg(F.count("*").alias("n")),
    "d13_quota_decisions": quota,
    "d14_entitlement_counts": lambda s, d: D.entitlement_counts(counts(s, d)),
    "d3_trailing_stream": lambda s, d: over_stream(s, d, lambda e: D.trailing_on_stream(e, 2, ["channel", "tier", "outcome"])),
    "d5_histogram_stream": lambda s, d: over_stream(s, d, lambda e: D.histogram_p95(D.snapshot_on_stream(e, 16)).select("channel", "tier", "quarter", "n", "rank", "bound", "tail")),
    "d6_alert_triggers_stream": lambda s, d: over_stream(s, d, lambda e: D.alert_triggers(D.histogram_p95(D.snapshot_on_stream(e, 16)))),
    "d14_entitlement_stream": lambda s, d: over_stream(s, d, D.entitlement_counts),
    "d8_alerts": lambda s, d: M.alerts(fired(s, d)).filter("kind <> 'recovered'").select("key", "ts", "trigger", "kind"),
    "d8_alert_stream": lambda s, d: alert_stream(s, d).filter("kind <> 'recovered'").select("key", "ts", "trigger", "kind"),
    "d9_recovery_stream": lambda s, d: alert_stream(s, d).filter("kind = 'recovered'").select("key", "ts", "n"),
    "f9_validate_events": lambda s, d: D.validate_events(funnel(s, d)).groupBy("name", "valid").agg(F.count("*").alias("n")),
}
QUERIES = {name: wall(f) for name, f in QUERIES.items()}

RAW = f"""raw as (select event_id, ts, user_id, case user_id % 7 when 0 then 'staging' when 1 then 'elsewhere' else 'production' end as channel, ['free', 'byok', 'pro', 'trial'][user_id % 4 + 1] as tier,
  case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in OUTCOME.items())} end as outcome, value * 4000 as ms, 100 + event_id % 600 as status, event_id % 3 = 0 as sampled from events),
nm as (select event_id, ts, user_id, case when channel in ('production', 'staging') then channel else 'unknown' end as channel, case when tier = 'trial' then 'unknown' else tier end as tier, coalesce(outcome, 'unknown') as outcome,
  case when ms is null or ms < 0 then 'unknown' when ms <= 30000 then '<=30s' when ms <= 60000 then '30-60s' when ms <= 120000 then '60-120s' else '>120s' end as latency, case when status between 100 and 599 then (status // 100) || 'xx' else 'unknown' end as status_class, case when sampled then 'sampled_1_of_20' else 'full' end as sampling from raw),
qc as (select time_bucket(interval 15 minutes, ts) as quarter, channel, tier, outcome, latency, count(*) as n from nm where channel <> 'unknown' and tier <> 'unknown' and outcome <> 'unknown' and latency <> 'unknown' group by all)"""
CELLS = [*[(f"l{i}", f"latency = '{b}'") for i, b in enumerate(D.LATENCIES)], *[(o, f"outcome = '{o}'") for o in D.OUTCOMES]]


def snap(quarters, source="qc"):
    sums = ", ".join(f"coalesce(sum(n) filter (where {c}), 0) as {n}" for n, c in CELLS)
    run = ", ".join(f"sum({n}) over w as {n}" for n, _ in CELLS)
    return f"""sg as (select channel, tier, quarter, {sums} from {source} group by all),
sn as (select channel, tier, quarter, {run} from sg window w as (partition by channel, tier order by quarter range between interval {quarters * 15} minutes preceding and current row))"""


HIST = f"""{RAW}, {snap(16)}, hi as (select *, l0 + l1 + l2 + l3 as n, ceil((l0 + l1 + l2 + l3) * 0.95)::bigint as rank from sn),
hb as (select *, case when n = 0 then null when l0 >= rank then '30s' when l0 + l1 >= rank then '60s' when l0 + l1 + l2 >= rank then '120s' else '>120s' end as bound, {Q.r6('coalesce(l3::double / nullif(n, 0), 0)', 5)} as tail from hi)"""
DENIED = "(entitlement_denied + entitlement_unavailable)"
TRIG = f"""{HIST}, tr as (select channel, tier, quarter, 'number_safety' as trigger, number_safety_failed::bigint as count from hb where number_safety_failed >= 1
union all select channel, tier, quarter, 'entitlement_pro', {DENIED}::bigint from hb where {DENIED} + completed >= 20 and {DENIED} >= 5
union all select channel, tier, quarter, 'p95_latency', n::bigint from hb where n >= 10 and bound = '>120s'
union all select channel, tier, quarter, 'latency_tail', l3::bigint from hb where n >= 10 and l3 > 0.05 * n
union all select channel, tier, quarter, 'monitor_blind', monitor_drop::bigint from hb where n = 0 or monitor_drop >= 3)"""
#: Alerts that went out, each the first that can an hour or more after the one before.
SENT = f"""{TRIG}, d as (select channel || '/' || tier as key, quarter as ts, trigger, count, count % 5 <> 0 as delivered from tr),
s(key, trigger, ts) as (select key, trigger, min(ts) from d where delivered group by all
  union all select s.key, s.trigger, min(d.ts) from s join d on d.key = s.key and d.trigger = s.trigger where d.delivered and d.ts >= s.ts + interval 1 hour group by all),
k as (select d.*, exists (select 1 from s where s.key = d.key and s.trigger = d.trigger and s.ts = d.ts) as sent, exists (select 1 from s where s.key = d.key and s.trigger = d.trigger and s.ts < d.ts and d.ts < s.ts + interval 1 hour) as held from d)"""
KINDS = f"with recursive {SENT} select key, ts, trigger, case when sent then 'alert' when held then 'held' else 'failed' end as kind from k"
FUN = "fu as (select event_id, ts, case when event_type = 'click' then 'Input Started' else upper(event_type[1]) || lower(event_type[2:]) end as name, event_id % 5 = 0 as bare, ['en', 'ko', 'xx'][user_id % 3 + 1] as lang from events)"

ORACLES = {
    "d1_normalize_events": f"with {RAW} select channel, tier, outcome, latency, status_class, sampling, count(*) as n from nm group by all",
    "d2_quarter_counts": f"with {RAW} select * from qc",
    "d3_trailing": f"with {RAW}, g as (select channel, tier, outcome, quarter, sum(n) as n from qc group by all) select channel, tier, outcome, quarter, (sum(n) over (partition by channel, tier, outcome order by quarter range between interval 30 minutes preceding and current row))::bigint as n from g",
    "d4_guard_time": "select event_id, ts from events where ts >= timestamp '2024-01-15 10:00:00' and ts <= timestamp '2024-01-15 12:15:00'",
    "d5_histogram_p95": f"with {HIST} select channel, tier, quarter, n::bigint as n, rank, bound, tail from hb",
    "d6_alert_triggers": f"with {TRIG} select * from tr",
    "d7_failure_streaks": "with f as (select *, event_type in ('error', 'signup') as f from events), g as (select *, sum((not f)::int) over (partition by user_id order by event_id) as g from f), s as (select event_id, user_id, case when f then sum(f::int) over (partition by user_id, g order by event_id) else 0 end as streak from g) select event_id, user_id, streak::bigint as streak, streak >= 2 as alert from s where streak > 0",
    "d8_cool_down": f"with recursive {SENT} select key.split('/')[1] as channel, key.split('/')[2] as tier, trigger, ts, count, delivered, sent from k",
    "d8_alerts": KINDS,
    "d8_alert_stream": KINDS,
    "d9_recovery": f"with {TRIG}, k as (select hb.channel || '/' || hb.tier as key, hb.quarter as ts, (select count(*) from tr where tr.channel = hb.channel and tr.tier = hb.tier and tr.quarter = hb.quarter) as n from hb), w as (select *, lag(n) over (partition by key order by ts) as before, max(case when n > 0 then ts end) over (partition by key order by ts rows between unbounded preceding and 1 preceding) as last_alert from k) select key, ts, last_alert from w where n = 0 and before > 0 and epoch(ts) - epoch(last_alert) <= 7200",
    "d10_failure_ratio": f"with {RAW}, g as (select channel, tier, sum(n)::bigint as total, sum(case when outcome in ('completed', 'quota_denied') then 0 else n end)::bigint as failed from qc group by all) select *, total >= 5 and failed > 0.5 * total as fires from g",
    "d11_funnel_daily": f"with {FUN}, r as (select *, ts::date as day, row_number() over (partition by ts::date order by ts, event_id) as rn from fu) select day, name, case when bare then 'surface=hero' else 'lang=' || lang || ',surface=chat' end as dims, count(*) as n from r where rn <= 20 group by all",
    "d12_dedup_deliveries": "with i as (select distinct (event_id % 1000)::varchar as id from events) select sha256(id)[1] as d, count(*) as n from i group by 1",
    "d13_quota_decisions": f"""with {RAW}, q as (select event_id, 1704067200 + (floor(epoch(ts) / 86400) - 19723)::bigint * 86400 + event_id % 7000 as t, tier, 's' || (user_id % 5) as subject, event_id % 900 as chars from raw),
a as (select *, t // 86400 as d, t // 3600 as h, strftime(to_timestamp(t) at time zone 'UTC', '%Y-%m') as m from q),
b as (select *, count(*) over (partition by tier, subject, d order by t, event_id rows unbounded preceding) > case tier when 'free' then 20 when 'pro' then 200 end as xd0 from a), b2 as (select *, coalesce(xd0, false) as xd from b),
c as (select *, sum((not xd)::int) over (partition by tier, subject, h order by t, event_id rows unbounded preceding) as nh, sum((not xd)::int) over (partition by tier, subject, m order by t, event_id rows unbounded preceding) as nm from b2),
e as (select *, not xd and tier = 'free' and nh > 10 as xh, not xd and tier = 'pro' and nm > 100 as xm from c),
f as (select *, case when not xd and not xm and chars > 0 then chars else 0 end as sz from e), g as (select *, sz > 0 and tier = 'pro' and sum(sz) over (partition by tier, subject, m order by t, event_id rows unbounded preceding) > 50000 as xc from f),
z as (select tier, event_id, case when tier = 'trial' then 'unsupported' when tier = 'byok' then '-' when xd then 'daily' when xh then 'hourly' when xm then 'monthly' when xc then 'characters' else '-' end as reason from g)
select tier, reason, count(*) as n, sum(event_id)::bigint as ids from z group by all""",
    "d14_entitlement_counts": f"with {RAW}, qp as (select * from qc where tier = 'pro'), {snap(1, 'qp')} select channel, quarter, number_safety_failed::bigint as number_safety, {DENIED}::bigint as refused, ({DENIED} + completed)::bigint as total, monitor_drop::bigint as dropped from sn",
    "f9_validate_events": f"with {FUN} select name, name = 'Input Started' and not bare and lang <> 'xx' as valid, count(*) as n from fu group by all",
}
ORACLES |= {f"{name}_stream": ORACLES[of] for name, of in (("d3_trailing", "d3_trailing"), ("d5_histogram", "d5_histogram_p95"), ("d6_alert_triggers", "d6_alert_triggers"), ("d14_entitlement", "d14_entitlement_counts"))}
