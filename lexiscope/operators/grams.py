"""Which of very many literals a text may hold: an index of each by its rarest run of characters, and a hash join.

A literal has one or more pieces that stand in a text as they are. Of the runs of up to three characters in its
longest-run pieces it is filed under the one that the fewest others have. A text is cut into all its runs where it lies; a bitmap
of fixed size, which is all that is broadcast, leaves those that file some literal, and these meet the
index in a join. What meets is a candidate: whoever asks verifies it in the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.session import materialise, prepare

RUN = 3
BITS = 24
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str, n: int) -> np.ndarray:
    """One whole number (int64) for each different run of n characters; different runs have different numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    k = len(c) - n + 1
    if k <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(k, np.uint64)
    for i in range(n):  # 21 bits hold any character; odd factors keep numbers apart
        out |= c[i : i + k] << np.uint64(21 * i)
    return np.unique(out * SPREAD).view(np.int64)


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """The top 24 bits of every 64-bit number, as two megabytes whatever their number."""
    top = F.shiftrightunsigned(F.col(column), 64 - BITS) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(top).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(top)).alias("m")).collect()
    whole = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        whole[(r["b"] - 1) * len(m) : r["b"] * len(m)] = m
    return whole


def filed(literals: DataFrame) -> DataFrame:
    """literals(lang, entry, pieces, ...) -> the same with `gram`, the run it is filed under; those without a character aren't filed."""
    prepare(literals.sparkSession)
    schema = literals.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = schema.fieldNames().index("pieces")
        for b in batches:
            found = []
            for pieces in b.column(place).to_pylist():
                n = min(RUN, max([0, *(len(p) for p in pieces or ())]))
                found.append(np.unique(np.concatenate([runs(p, n) for p in pieces])) if n else np.zeros(0, np.int64))
            size = [len(f) for f in found]
            take = pa.array(np.repeat(np.arange(b.num_rows), size))
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns], pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], [*b.schema.names, "gram"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    every = materialise(literals.mapInArrow(cut, f"{kinds}, gram long"))
    held = every.groupBy("lang", "gram").agg(F.count("*").alias("n of gram"))
    rest = F.struct(*[F.col(c) for c in literals.columns], "gram")
    best = every.join(held, ["lang", "gram"]).groupBy("lang", "entry").agg(F.min_by(rest, F.struct("n of gram", "gram")).alias("x"))
    return materialise(best.select("x.*"))


def candidates(units: DataFrame, keys: list[str], text: str, literals: DataFrame) -> DataFrame:
    """units(keys, lang, text), literals(lang, entry, pieces, ...) -> keys and the columns of literals but lang and pieces, for each pair that may be a hit.

    A literal that stands in a text is among its candidates. Texts are compared as they are, so case is the caller's."""
    index = filed(literals)
    sent = units.sparkSession.sparkContext.broadcast((bitmap(index, "gram"), sorted(r["n"] for r in index.select(F.least(F.lit(RUN), F.array_max(F.transform("pieces", F.char_length))).alias("n")).distinct().collect())))
    asked = units.select(*keys, "lang", F.col(text).alias("said"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = sent.value
        for b in batches:
            found = []
            for t in b.column(b.num_columns - 1).to_pylist():
                g = np.concatenate([np.zeros(0, np.int64), *(runs(t or "", n) for n in sizes)])
                top = (g.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
                found.append(g[(bits[top >> 3] >> (top & 7).astype(np.uint8)) & 1 == 1])
            take = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:-1]], pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], [*b.schema.names[:-1], "gram"])

    met = asked.mapInArrow(cut, f"{kinds}, gram long").join(index.drop("pieces"), ["lang", "gram"])
    return met.select(*keys, *[c for c in literals.columns if c not in ("lang", "pieces")])
