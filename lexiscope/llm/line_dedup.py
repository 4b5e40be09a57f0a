"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. The lines of a batch are hashed; those already in a run
belong to an earlier document and go; of the others, the smallest doc_id of the batch owns each hash.
The batch then adds its owned hashes as a new run. A run is a table bucketed by hash, each bucket one
sorted file, and so is the table of a batch's hashes: joins between them are merge joins of files as they
lie, without shuffle or sort. When a level has FAN runs they are merged, bucket by bucket, into
one of the next level, so the number of runs a batch meets grows with the logarithm of the number of batches.

DataFrame operations only. A frequent line is first reduced to one row per document and then, by
partial aggregation, to one row per task before any shuffle by hash; the way back to its documents is
a sort-merge join, whose large partitions Spark splits."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import materialise, unused
from lexiscope.session import delete, discard, shared_dir

FAN = 3
MIN_CHARS = 10
#: Lines of a batch and of a bucket, which set the number of both; the least and the most of each.
BATCH_LINES, BATCHES = 50_000_000, (4, 64)
BUCKET_LINES, BUCKETS = 2_000_000, (8, 20_000)
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: F.Column) -> F.Column:
    """Stripped at both ends, A-Z lower-cased; lower() does it where a line is ASCII alone."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_in(text: str | F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(key: F.Column) -> list[F.Column]:
    """h and g, 128 bits of a key together: the number comes before the key, so it is hashed under another seed and g doesn't follow from h."""
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


def lines_of(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, th (which of several texts), pos, h, g for each line whose key is long enough."""
    keys = F.transform(lines_in("text"), line_key)
    hashes = F.transform(keys, lambda k: F.when(F.char_length(k) >= MIN_CHARS, F.struct(*line_hashes(k))))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(hashes).alias("pos", "k")).filter("k is not null")
    return rows.select("doc_id", "th", "pos", "k.h", "k.g")


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Bucketed tables are read bucket by bucket, and a bucket of one file in its order."""
    keys = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.sources.bucketing.autoBucketedScan.enabled")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("true", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


class Runs:
    """The runs of a corpus so far: level -> tables of (h, g, owner)."""

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS[0]):
        self.spark, self.buckets = spark, buckets
        self.levels: dict[int, list[str]] = {}
        self.folders: dict[str, str] = {}
        self.merges = 0

    def __enter__(self) -> Runs:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for runs in self.levels.values() for name in runs]

    def write(self, rows: DataFrame) -> str:
        """A table below the shared folder, in buckets of one sorted file each if the rows come in the partitions of the buckets."""
        name = f"lexiscope_run_{uuid.uuid4().hex}"
        self.folders[name] = shared_dir(self.spark)
        rows.write.format("parquet").option("path", self.folders[name]).bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, self.folders.pop(name))

    def hashes(self, lines: DataFrame) -> str:
        """The table of a batch's hashes: h, g, the smallest doc_id as owner, and whether there are many."""
        found = lines.groupBy("h", "g").agg(F.min("doc_id").alias("owner"), (F.min("doc_id") != F.max("doc_id")).alias("many"))
        return self.write(found.repartition(self.buckets, "h", "g"))

    def fresh(self, found: DataFrame) -> DataFrame:
        """The rows of a table of hashes that are in no run."""
        return reduce(lambda x, run: x.join(run.hint("merge"), ["h", "g"], "left_anti"), self.tables(), found)

    def seen(self, found: DataFrame) -> list[DataFrame]:
        """(h, g, owner) of those that are in one, run by run."""
        return [found.select("h", "g").join(run.hint("merge"), ["h", "g"]).select("h", "g", "owner") for run in self.tables()]

    def add(self, rows: DataFrame, level: int = 0) -> None:
        """A new run; a full level is merged into the next. A hash is in one run only, so an outer join on it merges runs in their order."""
        with sorted_buckets(self.spark):
            name = self.write(rows.select("h", "g", "owner"))
        self.levels.setdefault(level, []).append(name)
        if len(self.levels[level]) >= FAN:
            old, self.levels[level] = self.levels[level], []
            self.merges += 1
            self.add(merged([self.spark.table(name) for name in old]), level + 1)
            self.drop(*old)

    def close(self) -> None:
        """All tables go, those that an error left too."""
        self.drop(*list(self.folders))
        self.levels = {}


def merged(runs: list[DataFrame]) -> DataFrame:
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.withColumnRenamed("owner", "other"), ["h", "g"], "full").select("h", "g", F.coalesce("owner", "other").alias("owner"))

    return reduce(both, runs)


def drops(lines: DataFrame, runs: Runs) -> DataFrame:
    """The lines of one batch -> (doc_id, th, drop) with the places that go; the batch's own hashes become a run.

    The hashes of the batch are joined with the runs only, never with other documents."""
    spark = lines.sparkSession
    name = runs.hashes(lines)
    found = spark.table(name)
    with sorted_buckets(spark):
        # an owner in a run is smaller than any doc_id of this batch
        shared = materialise(reduce(DataFrame.unionByName, runs.seen(found), runs.fresh(found).filter("many").select("h", "g", "owner")))
    runs.add(runs.fresh(found))
    runs.drop(name)
    lost = lines.join(shared, ["h", "g"]).filter("doc_id <> owner")
    out = materialise(lost.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop")))
    discard(shared)
    return out


def bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that cut the table into batches of about equal size; approximate, for any cut is right."""
    if batches <= 1:
        return []
    at = docs.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"]
    return sorted(set(at or []))


def by_volume(lines: int, size: int, limits: tuple[int, int]) -> int:
    return min(limits[1], max(limits[0], lines // size + 1))


def dedup_lines(docs: DataFrame, batches: int | None = None, buckets: int | None = None, counts: bool = True) -> DataFrame:
    """docs(doc_id, text) -> docs with all its columns, the text without its dropped lines, and n_lines, n_dropped if `counts`.

    A line's key of ten code points or more that is in two documents or more stays only in the
    smallest doc_id that holds it, there at every place. Shorter keys always stay. A null or empty
    text is one empty line and becomes an empty text. Rows that repeat a doc_id are one document; a
    null doc_id is larger than any other. Extra columns stay, whatever their names; with `counts`, those
    named n_lines or n_dropped are replaced. An empty table gives an empty result."""
    spark = docs.sparkSession
    last = F.lit((1 << 63) - 1)
    every = materialise(lines_of(docs.select(F.coalesce("doc_id", last).alias("doc_id"), "text")))
    n = every.count()
    cuts, gone = bounds(every, by_volume(n, BATCH_LINES, BATCHES) if batches is None else batches), []
    with Runs(spark, buckets or by_volume(n, BUCKET_LINES, BUCKETS)) as runs:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = every
            if low is not None:
                batch = batch.filter(F.col("doc_id") > low)
            if high is not None:
                batch = batch.filter(F.col("doc_id") <= high)
            gone.append(drops(batch, runs))
    discard(every)
    at, th, drop, lost, kept = unused(docs, "at", "th", "drop", "lost", "kept")
    rest = reduce(DataFrame.unionByName, gone).select(F.col("doc_id").alias(at), F.col("th").alias(th), F.col("drop").alias(drop))
    joined = docs.join(rest, (F.coalesce("doc_id", last) == F.col(at)) & (F.xxhash64("text") == F.col(th)), "left")
    lines = lines_in("text")
    held = F.filter(lines, lambda x, i: F.element_at(lost, i).isNull())
    out = joined.withColumn(lost, F.map_from_arrays(drop, drop)).withColumn(kept, F.when(F.col(at).isNull(), lines).otherwise(held))
    new = {"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(kept)).cast("long")} if counts else {}
    return out.select(*[F.array_join(kept, "\n").alias("text") if c == "text" else c for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def oracle(table: str = "documents") -> str:
    """The rows of op7 in SQL."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = f"translate(trim(line, {blank}), '{UPPER}', '{LOWER}')"
    return f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from {table}),
k as (select doc_id, pos, line, {key} as key from l),
o as (select key, min(doc_id) as owner, count(distinct doc_id) as n from k where length(key) >= {MIN_CHARS} group by key),
m as (select k.doc_id, pos, line, coalesce(o.n >= 2 and o.owner <> k.doc_id, false) as gone from k left join o on k.key = o.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id"""
