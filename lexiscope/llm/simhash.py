"""SimHash near-duplicates, found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect binary Golay code
[23, 12, 7] gives each segment one codeword index where a codeword is within two bits, else six (the
nearest and the five at four bits); two segments at most two bits apart always share an index.

Up to four differing bits fall on three segments in one of two ways:
* a segment has none: one of the other two has at most two, so (that segment, index of the other) agree;
* each has at least one, so each has at most two: all three indices agree.
These keys have 33 to 36 bits, so unrelated fingerprints seldom meet whatever the size of the corpus.

Fingerprints that share a key are verified by their Hamming distance. Within a bucket a search takes
each found neighbour out of the rest, so it emits a star for each component of the bucket and never its
pairs; buckets above HOT fingerprints are cut into blocks, and each pair of blocks is its own task."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import components, materialise, per_document, unused
from lexiscope.session import prepare

BITS = 4
CUTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011
HOT = 4096


# --- fingerprints ----------------------------------------------------------------------------


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of the word shingles of a text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()  # lower() and split() of bytes know ASCII only
    n = len(parts)
    if not n:
        return 0
    line, k = b" ".join(parts), min(words, n)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, counts = n - k + 1, np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):
        to = min(total, at + (1 << 15))
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        h = np.array([xxh64_intdigest(line[i:j], 42) for i, j in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp). Null and empty texts have fingerprint 0."""
    return per_document(docs, ["doc_id", "text"], lambda i, t: {"doc_id": i, "fp": [fingerprint(x, words) for x in t]}, "doc_id long, fp long")


# --- keys ------------------------------------------------------------------------------------


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each 12-bit head, and for each remainder its one or six error patterns (padded with the first)."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    bit = [rest(1 << i) for i in range(23)]
    head = np.array([rest(i << 11) for i in range(4096)], np.uint32)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            r, e = 0, 0
            for i in places:
                r, e = r ^ bit[i], e | 1 << i
            if weight < 4 or bin(found[r][0]).count("1") == 3:
                found[r].append(e)
    return head, np.array([x + [x[0]] * (6 - len(x)) for x in found], np.uint32)


def indices(segment: np.ndarray) -> np.ndarray:
    """(n,) segments of up to 23 bits -> (n, 6) indices of nearby codewords; repeats where there is one."""
    head, errors = golay()
    x = segment.astype(np.uint32)
    return (x[:, None] ^ errors[head[x >> 11] ^ (x & 0x7FF)]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints -> (row, key), distinct for each row."""
    x = fps.view(np.uint64)
    seg = [(x >> np.uint64(at)) & np.uint64((1 << size) - 1) for at, size in CUTS]
    idx = [indices(s).astype(np.uint64) for s in seg]
    one = [(i[:, 1:] == i[:, :1]).all(axis=1) for i in idx]
    use = [np.concatenate([np.ones((len(x), 1), bool), np.repeat(~o[:, None], 5, axis=1)], axis=1) for o in one]
    rows, keys = [], []
    for n, (a, b) in enumerate((a, b) for a in range(3) for b in range(3) if a != b):
        r, c = np.nonzero(use[b])
        rows.append(r)
        keys.append(np.uint64(n + 1) << np.uint64(36) | seg[a][r] << np.uint64(12) | idx[b][r, c])
    r, a, b, c = np.nonzero(use[0][:, :, None, None] & use[1][:, None, :, None] & use[2][:, None, None, :])
    rows.append(r)
    keys.append(idx[0][r, a] << np.uint64(24) | idx[1][r, b] << np.uint64(12) | idx[2][r, c])
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def near(fps: np.ndarray, x: np.ndarray | int, bits: int) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint64) ^ np.asarray(x, np.int64).view(np.uint64)) <= bits


def stars(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The components of distinct sorted fingerprints under the distance, as edges (first, other)."""
    left, right, rest = [], [], fps
    while len(rest):
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            hit = near(rest, queue.pop(), bits)
            if hit.any():
                new = rest[hit]
                left.append(np.full(len(new), root))
                right.append(new)
                rest = rest[~hit]
                queue.extend(new)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def link_runs(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from whole runs of equal keys; rows are sorted by (key, fp)."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    first = np.repeat(start, size)
    close = near(fp, fp[first], bits)
    other = close & (fp != fp[first])
    left, right = [fp[first][other]], [fp[other]]
    open_ = np.bitwise_and.reduceat(close, start) == 0
    for s, n in zip(start[open_].tolist(), size[open_].tolist(), strict=True):
        if n > 2:
            a, b = stars(np.unique(fp[s : s + n]), bits)
            left.append(a)
            right.append(b)
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Distinct fps(fp) -> edges(a, b) that connect just what links of at most `bits` bits connect."""
    if not 0 <= bits <= BITS:
        raise ValueError("the keys hold for up to four bits")
    prepare(fps.sparkSession)

    def spread(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 1024):
                x = whole[at : at + 1024]
                rows, keys = keys_of(x)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(x[rows])], ["key", "fp"])

    def meet(batches):
        """Edges as (a, b, null); what belongs to a run longer than `hot` as (fp, null, key)."""

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

        def aside(k, f):
            return pa.RecordBatch.from_arrays([pa.array(f), pa.nulls(len(f), pa.int64()), pa.array(k)], ["a", "b", "key"])

        held_k = held_f = np.zeros(0, np.int64)
        large: int | None = None
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            if large is not None and k[0] == large:
                n = int(np.searchsorted(k, large, side="right"))
                yield aside(k[:n], f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    held_k = held_f = np.zeros(0, np.int64)
                    continue
            large = None
            cut = int(np.searchsorted(k, k[-1], side="left"))
            whole_k, whole_f, held_k, held_f = k[:cut], f[:cut], k[cut:], f[cut:]
            if len(held_k) > hot:
                large = int(held_k[0])
                yield aside(held_k, held_f)
                held_k = held_f = np.zeros(0, np.int64)
            yield from finish(whole_k, whole_f, out, aside)
        yield from finish(held_k, held_f, out, aside)

    def finish(k, f, out, aside):
        if not len(k):
            return
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(start, len(k)))
        many = np.repeat(size > hot, size)
        if many.any():
            yield aside(k[many], f[many])
        keep = np.repeat(size > 1, size) & ~many
        if keep.any():
            a, b = link_runs(k[keep], f[keep], bits)
            if len(a):
                yield out(a, b)

    keys = fps.select("fp").mapInArrow(spread, "key long, fp long")
    met = materialise(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long, key long"))
    edges, hot_rows = met.filter("b is not null").select("a", "b"), met.filter("b is null").select("key", F.col("a").alias("fp"))
    if not hot_rows.isEmpty():
        edges = edges.unionByName(in_blocks(hot_rows, bits, hot))
    return edges.distinct()


def in_blocks(rows: DataFrame, bits: int, size: int) -> DataFrame:
    """Hot buckets: rows(key, fp) in blocks of about `size`; a task for each two blocks of a key."""

    def both(table: pa.Table) -> pa.Table:
        a, b = stars(np.unique(table.column("fp").to_numpy()), bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("n"))
    dealt = rows.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", "fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return dealt.groupBy("key", "i", "j").applyInArrow(both, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """docs(doc_id, text) -> one row per document: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links of at most `bits` differing bits, the
    document's own included. Texts without words (null, empty, blank) have fingerprint 0 and link like
    any other. Repeated rows stay. A null doc_id stays and counts for no minimum; a component of
    nulls has a null id. An empty table gives an empty result. Other columns are ignored."""
    marked = materialise(fingerprints(docs, words))
    firsts = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), bits))
    placed = materialise(firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = materialise(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    # written, so that each join is of plain shuffles and Spark can split a hot fingerprint
    found = materialise(placed.join(ids, "root").select("fp", "component_id"))
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, bits: int = BITS) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; all columns are kept.

    Rows that repeat a doc_id count as one document, so one of them stays. Rows without a doc_id
    can't be told apart and all stay. At four bits or fewer the estimated cosine of two
    shingle sets is 0.98 or more, so every group is above the similarity of 0.8."""
    return keep_first(docs, near_duplicates(docs, words, bits))


def keep_first(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs without the documents that marked(doc_id, component_id) places under another id; a repeated doc_id stays once."""
    at, n = unused(docs, "id", "n")
    ids = marked.filter("doc_id is not null").groupBy(F.col("doc_id").alias(at)).agg(F.count("*").alias(n), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    # those that go are fewer than those that stay; written, so that their size is known when the join is planned
    some = materialise(ids.filter(~F.col("stays") | (F.col(n) > 1)))
    out = docs.join(some.select(at), F.col("doc_id") == F.col(at), "left_anti")
    again = some.filter("stays").select(at)
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, F.col("doc_id") == F.col(at), "left_semi").dropDuplicates(["doc_id"]))
    return out
