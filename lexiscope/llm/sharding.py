"""Shards of near equal bytes by sampled splitters.

Records are ordered by (MD5 of the text, doc_id), so equal texts lie together and a hot group can still
be cut between its documents. A sample, drawn with a chance in proportion to a record's size, gives
quantile boundaries for ranges of about equal bytes. Ranges that turn out overfull are cut again at
boundaries of a finer sample of their own. Each range then sorts its own records; the totals of the
ranges give every record its place in the whole order, and the place in bytes gives the shard. So the
result is exact and the sample decides only how the work is spread.

DataFrame operations only; what comes to the driver is bounded by the number of ranges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import materialise

OVERHEAD = 8
#: Records of a range (some tens of bytes each), and the most ranges.
RANGE_ROWS, MOST = 1_000_000, 4096
#: Boundaries that a table of 16 rows holds.
SHORT = 256
LAW = "bytes"


def splitters(keyed: DataFrame, total: int, ranges: int, per_range: int, salt: int) -> list[tuple[str, int]]:
    """Boundaries of `ranges` ranges from a size-weighted sample of about ranges x per_range keys."""
    chance = F.col("size") * F.lit(ranges * per_range / max(total, 1))
    draw = F.pmod(F.xxhash64("k", "d", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = sorted((r["k"], r["d"]) for r in keyed.filter(draw < chance).select("k", "d").distinct().collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def below(bounds: F.Column, key: F.Column) -> F.Column:
    """How many boundaries of a sorted list are at or below a key."""
    return F.size(F.filter(bounds, lambda b: b <= key))


def ranged(keyed: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """keyed with r, the number of boundaries at or below a record's key.

    Boundaries are looked up by the first digits of the key in a table of at most 4,096 rows, each with the
    number of boundaries before it and those that begin alike. The table comes as one piece of JSON, so the plan
    stays small and no Python worker is started."""
    if not bounds:
        return keyed.withColumn("r", F.lit(0))
    digits = 1 if len(bounds) <= SHORT else 3
    rows, at = [], 0
    for n in range(16**digits):
        prefix = f"{n:0{digits}x}"
        end = at
        while end < len(bounds) and bounds[end][0].startswith(prefix):
            end += 1
        rows.append({"prefix": prefix, "base": at, "own": [{"k": k, "d": d} for k, d in bounds[at:end]]})
        at = end
    kind = "array<struct<prefix:string,base:int,own:array<struct<k:string,d:bigint>>>>"
    table = keyed.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
    x = keyed.join(F.broadcast(table), F.substring("k", 1, digits) == F.col("prefix"))
    return x.withColumn("r", F.col("base") + below(F.col("own"), F.struct("k", "d"))).select(*keyed.columns, "r")


def shards(docs: DataFrame, n: int = 24, ranges: int | None = None, per_range: int = 64, overfull: float = 2.0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 bytes of the text (null: none) plus 8. A record whose bytes before it, in the
    whole order, are a share s of all bytes is in shard floor(s n); so the shards' bytes differ by one
    record at most. slot counts a shard's records in that order. The law is `bytes`, so grown_shard is null.
    A null text is ordered as the empty one, a null doc_id before all others. Rows that repeat are each
    a record. An empty table gives an empty result. Other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    keyed = materialise(docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.md5(text.cast("binary")).alias("k"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    whole = keyed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = whole["bytes"] or 0
    ranges = ranges or min(MOST, max(4 * n, whole["rows"] // RANGE_ROWS + 1))
    bounds = splitters(keyed, total, ranges, per_range, 0)
    dealt = ranged(keyed, bounds)
    sizes = {r["r"]: r["b"] for r in dealt.groupBy("r").agg(F.sum("size").alias("b")).collect()}
    large = [r for r, b in sizes.items() if b > overfull * total / ranges]
    if large:  # at most as many as there are ranges, cut into as many pieces as all ranges together
        more = splitters(dealt.filter(F.col("r").isin(large)), sum(sizes[r] for r in large), max(2, sum(int(ranges * sizes[r] / total) + 1 for r in large)), 4 * per_range, 1)
        bounds = sorted({*bounds, *more})
        dealt = ranged(keyed, bounds)
    within = Window.partitionBy("r").orderBy("k", "d")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(dealt.withColumns({"before": F.coalesce(F.sum("size").over(upto), F.lit(0)), "row": F.row_number().over(within) - 1}))
    # the totals of the ranges: a row for each, so a single task for their running sums is enough
    sums = placed.groupBy("r").agg(F.sum("size").alias("b"))
    offset = sums.select("r", F.coalesce(F.sum("b").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    # exact in whole numbers: decimals hold bytes x n at any size
    in_shard = placed.join(F.broadcast(offset), "r").withColumn("shard", F.expr(f"cast((cast(offset + before as decimal(28,0)) * {n}) div {max(total, 1)} as int)"))
    parts = in_shard.groupBy("shard", "r").agg(F.count("*").alias("c"), F.min("row").alias("first"))
    earlier = parts.select("shard", "r", "first", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    out = in_shard.join(F.broadcast(earlier), ["shard", "r"])
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("skip") + F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def oracle(table: str = "documents", n: int = 24) -> str:
    """The rows of op8 in SQL. DuckDB has no CRC-32 function, so it is worked out byte by byte elsewhere: see the tests."""
    return f"""
with d as (select doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} as size from {table}),
o as (select *, sum(size) over (order by md5(t), doc_id rows between unbounded preceding and current row) - size as before, sum(size) over () as total from d),
s as (select *, cast((before * {n}) // total as integer) as shard from o)
select doc_id, size, '{LAW}' as law, shard, row_number() over (partition by shard order by md5(t), doc_id) - 1 as slot from s"""
