"""Shared pieces: tables written to the shared folder, bitmaps of keys, connected components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.session import materialise, prepare


def open_fs(uri: str):
    """The file system of a whole URI and the path in it; a scheme the workers' library knows (file, hdfs, s3, gs)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks before it as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def per_document(docs: DataFrame, columns: list[str], f: Callable[..., Iterator[dict]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """Run f over slices of the named columns, given as Python lists; f returns one list for each column of the schema.

    `done` is called when a task ends: what f keeps for a worker process would stay in its memory for all later tasks."""
    from pyspark.sql.types import StructType

    prepare(docs.sparkSession)
    kinds = StructType.fromDDL(schema)
    names = [x.name for x in kinds]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        try:
            for batch in batches:
                for part in slices(batch):
                    out = f(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)
        finally:
            if done:
                done()

    return docs.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about two megabytes of text, and one row at least."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


# --- bitmaps of keys -------------------------------------------------------------------------

BITMAP_BITS = 24


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """The top 24 bits of every 64-bit key as one 2 MB bitmap, whatever the number of keys.

    It only spares keys that can't match from the join that follows, so its size is fixed
    and nothing that grows is broadcast."""
    top = F.shiftrightunsigned(F.col(column), 64 - BITMAP_BITS)
    rows = (
        keys.select(top.alias("t"))
        .groupBy(F.bitmap_bucket_number(F.col("t") + 1).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("t") + 1)).alias("m"))
        .collect()
    )
    whole = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in rows:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["b"] - 1) * len(m)
        whole[at : at + len(m)] = m
    return whole


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    top = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[top >> 3] >> (top & 7).astype(np.uint8)) & 1 == 1


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each window of k values (uint64); none if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += values[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges(a, b) -> (node, root) for every node with an edge; root is the smallest node of its component.

    Large-star and small-star rounds. Each takes minima by partial aggregation, writes them, and joins
    them back; as both sides of that join are plain shuffles, Spark can split the neighbours of a hub
    between tasks. Rounds end when nothing changes."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = materialise(e)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # a node without larger neighbours still hangs on its own minimum
        large = large.unionByName(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        large = materialise(large)
        low2 = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # settled when every node has one edge and no root hangs on another node
        now = e.agg(F.count("*").alias("n"), F.sum(F.col("u").cast("decimal(38,0)")).alias("s"), F.sum(F.col("v").cast("decimal(38,0)")).alias("t")).first()
        now = (now["n"], now["s"], now["t"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
