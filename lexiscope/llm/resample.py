"""Importance resampling towards a target: hashed n-gram weights, Gumbel scores, a cutoff by bisection.

Each feature of a text, a run of one to three words, falls into a bucket. The gain of a bucket compares how
often it occurs in the target with how often in the documents; a document's weight is the sum of its features'
gains, read from one array, and its score adds noise that depends on its id alone. The highest
scores are drawn. Their number is known, so the cutoff is found without a sort: scores are written once, and
jobs that only count rows at or above a few thresholds narrow the interval until one value is left; then
likewise among the doc_ids of equal score, and among rows that share both. What is above is dealt out by
ranges, and the ranges' counts give each row its rank.

Only counts by bucket come to the driver and only the gains are broadcast: as many numbers as there are buckets."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import materialise, slices
from lexiscope.session import prepare

BUCKETS, LENGTHS, SEED = 10_000, 3, 42
LEAST_WORDS, SHARE = 20, (5, 100)
#: Thresholds that one counting job tries.
WAYS = 15
#: Bytes of a text that are cut into words at a time, and words of a block.
BLOCK, KEPT = 1 << 20, 400_000
UPPER, LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: A-Z lower-cased; ASCII that is neither a digit nor a letter becomes a space.
PLAIN = bytes(b + 32 if b in UPPER else b if b >= 0x80 or b in LOWER or 0x30 <= b <= 0x39 else 0x20 for b in range(256))


# --- features --------------------------------------------------------------------------------


@cache
def powers() -> np.ndarray:
    """(32, 4, 256): what 2^j zero bytes after it make of a CRC-32, for each of its bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    one = [np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)]
    out = np.zeros((32, 4, 256), np.uint32)
    out[0] = [(x >> np.uint32(8)) ^ byte[x & 255] for x in one]
    for j in range(1, 32):
        out[j] = [advance(out[j - 1], x) for x in out[j - 1]]
    return out


def advance(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings one after the other, from that of each and the length of the second."""
    out, j, table = first.copy(), 0, powers()
    while length.any() and int(length.max()) >> j:
        at = np.flatnonzero(length >> j & 1)
        out[at] = advance(table[j], out[at])
        j += 1
    return out ^ second


class Crcs(dict):
    """Word -> its CRC-32, and above that the CRC-32 of a space and the word. Bounded, as it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        self[word] = both = zlib.crc32(b" " + word) << 32 | zlib.crc32(word)
        return both


def blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a block of about a megabyte at a time."""
    plain = (text or "").encode().translate(PLAIN)
    at = 0
    while at < len(plain):
        to = at + BLOCK
        if to < len(plain):
            cut = plain.rfind(b" ", at, to)
            to = cut if cut > at else (plain.find(b" ", to) + 1 or len(plain) + 1) - 1
        yield plain[at:to].split()
        at = to


def features(texts: list[str | None], memo: Crcs, buckets: int, lengths: int = LENGTHS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket) of all features of the texts and the text of each word, in blocks; a long text is cut, and its runs across a cut are kept."""
    words: list[bytes] = []
    owner: list[np.ndarray] = []
    fresh: list[np.ndarray] = []
    for n, text in enumerate(texts):
        carry: list[bytes] = []
        for block in blocks(text):
            words += carry + block
            owner.append(np.full(len(carry) + len(block), n))
            fresh += [np.zeros(len(carry), bool), np.ones(len(block), bool)]
            carry = (carry + block)[1 - lengths :] if lengths > 1 else []
            if len(words) > BLOCK // 4:
                yield of_block(words, np.concatenate(owner), np.concatenate(fresh), memo, buckets, lengths)
                words, owner, fresh = [], [], []
    if words:
        yield of_block(words, np.concatenate(owner), np.concatenate(fresh), memo, buckets, lengths)


def of_block(words: list[bytes], owner: np.ndarray, fresh: np.ndarray, memo: Crcs, buckets: int, lengths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(memo) > KEPT:
        memo.clear()
    both = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    own, spaced = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
    crc, texts, found = own, [owner[fresh]], [own[fresh] % np.uint32(buckets)]
    for k in range(1, lengths):  # the last word of a run is new, and all are of one text
        crc = joined(crc[: len(words) - k], spaced[k:], size[k:])
        at = np.flatnonzero(fresh[k:] & (owner[k:] == owner[: len(owner) - k]))
        texts.append(owner[k:][at])
        found.append(crc[at] % np.uint32(buckets))
    return np.concatenate(texts), np.concatenate(found), owner[fresh]


def counts(rows: DataFrame, buckets: int, lengths: int = LENGTHS) -> np.ndarray:
    """How often each bucket occurs in rows(text)."""
    prepare(rows.sparkSession)

    def run(batches):
        memo, total = Crcs(), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, found, _ in features(part.column(0).to_pylist(), memo, buckets, lengths):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, object)
    for r in rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        out[r["bucket"]] = int(r["n"])
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    s_all, t_all, n = float(docs.sum() + len(docs)), float(target.sum() + len(docs)), len(docs)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * s_all / ((float(docs[b]) + 1) * t_all))) for b in range(n)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel draw) that depends on the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED, lengths: int = LENGTHS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight, score."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(gain)

    def run(batches):
        memo, gain = Crcs(), sent.value
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                totals = np.zeros((3, n), np.int64)
                for owner, found, word in features(part.column(1).to_pylist(), memo, len(gain), lengths):
                    totals += [np.bincount(word, minlength=n), np.bincount(owner, minlength=n), np.bincount(owner, gain[found], n).astype(np.int64)]
                score = totals[2] + np.array([noise(i, seed) for i in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in (*totals, score)]], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# --- the cutoff ------------------------------------------------------------------------------


def cutoff(rows: DataFrame, value: Column, n: int, ways: int = WAYS) -> tuple[int, int, int]:
    """The largest v that at least n rows reach (1 <= n <= rows), how many are above v, and how many are at it."""
    x = rows.select(value.alias("x"))
    ends = x.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    low, high, reach = ends["low"], ends["high"], {ends["low"]: ends["n"], ends["high"] + 1: 0}
    while low < high:  # `low` is reached by n rows, `high` + 1 is not
        tried = sorted({low + (high - low) * i // ways for i in range(1, ways + 1)} | {high} - {low})
        tried = [t for t in tried if t > low]
        got = x.agg(*[F.count_if(F.col("x") >= F.lit(t)).alias(f"n{i}") for i, t in enumerate(tried)]).first()
        reach |= {t: got[f"n{i}"] for i, t in enumerate(tried)}
        low = max([low, *[t for t in tried if reach[t] >= n]])
        high = min([high, *[t - 1 for t in tried if reach[t] < n]])
    if low + 1 not in reach:
        reach[low + 1] = x.filter(F.col("x") > F.lit(low)).count()
    return low, reach[low + 1], reach[low] - reach[low + 1]


def drawn(rows: DataFrame, order: list[Column], n: int) -> Column:
    """The first n rows in a descending order of whole numbers, the last of which no two rows share, as a condition."""
    took, ties, condition = F.lit(False), F.lit(True), F.lit(False)
    for value in order:
        at, above, equal = cutoff(rows, value, n)
        took = took | ties & (value > at)
        ties = ties & (value == at)
        condition = took | ties
        if n == above + equal:
            break
        rows, n = rows.filter(value == at), n - above
    return condition


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with their rank, from 1, in a descending order, over ranges of it."""
    names = rows.columns
    dealt = rows.repartitionByRange(*[v.desc() for v in order]).sortWithinPartitions(*[v.desc() for v in order])

    def number(batches):
        from pyspark import TaskContext

        own, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, own, np.int32)), pa.array(np.arange(at + 1, at + 1 + b.num_rows))], [*names, "own_range", "place"])
            at += b.num_rows

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    x = materialise(dealt.mapInArrow(number, f"{kinds}, own_range int, place long"))
    # a row for each range, so a single task for their running sums is enough
    before = x.groupBy("own_range").agg(F.count("*").alias("n")).select("own_range", F.coalesce(F.sum("n").over(Window.orderBy("own_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return x.join(before, "own_range").select(*names, (F.col("before") + F.col("place")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank of every row of docs.

    Of the N rows with at least `least_words` words, floor(N share) with the highest scores are drawn and have
    a rank 1, 2, 3...; of equal scores the smaller doc_id comes first, a null one last, and of rows that
    share a doc_id and a score the one that was written first. Others have a null rank. A null or empty text has no
    features and the weight 0. Repeated rows each count; rows of one doc_id share their noise; a null doc_id has
    that of the word null. Without a target the gains compare with nothing seen. An empty table gives
    an empty result. Other columns are ignored."""
    gain = gains(counts(docs, buckets), counts(target, buckets))
    scored = materialise(scores(docs, gain, seed).withColumn("line", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= least_words)
    n = share[0] * able.count() // share[1]
    names, none = ["doc_id", "n_features", "weight", "score"], F.lit(None).cast("long").alias("rank")
    if not n:
        return scored.select(*names, none)
    # ~x turns an order of longs round
    order = [F.col("score"), F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))), F.bitwise_not("line")]
    chosen = (F.col("n_words") >= least_words) & drawn(able, order, n)
    return ranked(scored.filter(chosen), order).select(*names, "rank").unionByName(scored.filter(~chosen).select(*names, none))
