"""Near-duplicates by the exact Jaccard similarity of word shingles, with MinHash bands for candidates.

A document is the set of its distinct shingle hashes; equal sets are one node from the start. The
minima of a node under BANDS x ROWS hash functions give one key for each band; a pair at similarity s
shares one with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8.

Keys only propose. Every link is verified by the sets themselves, in two steps that never list the pairs of a group:
* each node of a bucket against the smallest one, and the components of what holds;
* buckets of three nodes or more that are still in several components are searched whole, in blocks.

Sets are cut a second time from the texts, only for nodes that share a bucket: a bitmap of fixed size spares the others."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiscope.llm.common import components, in_bitmap, key_bitmap, materialise, per_document, rolling
from lexiscope.llm.licenses import Words
from lexiscope.llm.simhash import keep_first
from lexiscope.session import prepare

K, SHARE, BANDS, ROWS = 5, 0.8, 20, 5
#: Bytes of sets in a block of a bucket that is searched whole.
BLOCK = 4 << 20
DRAW = np.random.default_rng(11)
TIMES, PLUS = DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1), DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


# --- sets and keys ---------------------------------------------------------------------------


def shingles(text: str | None, words: int, memo: Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a text of fewer words is one shingle."""
    parts = (text or "").encode().lower().split()  # lower() and split() of bytes know ASCII only
    return np.unique(rolling(memo.hashes(parts), min(words, len(parts)))) if parts else np.zeros(0, np.uint64)


def node_of(values: np.ndarray, clash: dict[int, int], bits: int = 64) -> tuple[int, int]:
    """(node, check) of a set: two halves of a 128-bit digest, the first cut to `bits` bits.

    `clash` has the first halves that several sets share, each with the check of the set that keeps it; others get
    a node from both halves instead."""
    whole = blake2b(values.tobytes(), digest_size=16)
    node, check = np.frombuffer(whole.digest(), np.int64).tolist()
    node = node & ((1 << bits) - 1) if bits < 64 else node
    if clash.get(node, check) != check:
        node = int(np.frombuffer(blake2b(whole.digest(), digest_size=8, salt=b"again").digest(), np.int64)[0])
    return node, check


def marked_nodes(docs: DataFrame, cut: Callable[[str | None], np.ndarray], more: Callable[[np.ndarray, int], dict], schema: str, bits: int = 64) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """docs(doc_id, text) -> (doc_id, node and what `more` says of its set) for every row, (node, first doc_id, ...) for every
    distinct set, and the clashes of nodes.

    Two different sets get one node only if 128 bits agree. If 64 do, which befalls one pair of 6 x 10^9 sets on average,
    rows are marked again and the second gets another node; so the clashes that come to the driver are few at any size."""
    clash: dict[int, int] = {}
    names = [x.name for x in StructType.fromDDL(schema)]
    while True:

        def run(ids, texts, clash=clash):
            sets = [cut(t) for t in texts]
            nodes = [node_of(s, clash, bits) for s in sets]
            said = [more(s, n) for s, (n, _) in zip(sets, nodes, strict=True)]
            return {"doc_id": ids, "node": [n for n, _ in nodes], "check": [c for _, c in nodes]} | {c: [x[c] for x in said] for c in names}

        marked = materialise(per_document(docs, ["doc_id", "text"], run, f"doc_id long, node long, check long, {schema}"))
        firsts = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("check").alias("check"), F.max("check").alias("other"), *[F.first(c).alias(c) for c in names]))
        again = {r["node"]: r["check"] for r in firsts.filter("check <> other").select("node", "check").collect()}
        if not again:
            return marked.drop("check"), firsts.drop("check", "other"), clash
        clash = clash | again


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band (int64); none for the empty set."""
    if not len(values):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        low = np.minimum(low, (values[at : at + 1024] * TIMES[:, None] + PLUS[:, None]).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


# --- verified links --------------------------------------------------------------------------


def verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """pairs(a, b), sets(node, items) -> those whose similarity is `share` or more."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= share * max(len(x), len(y)) else 0
                keep.append(both > 0 and both / (len(x) + len(y) - both) >= share)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    side = lambda node, items: sets.select(F.col("node").alias(node), F.col("items").alias(items))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def stars(nodes: np.ndarray, sets: list[np.ndarray], share: float) -> tuple[list[int], list[int]]:
    """The components of distinct nodes under the similarity of their sets, as edges (first, other)."""
    size = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    left, right, rest = [], [], np.ones(len(nodes), bool)
    for root in range(len(nodes)):
        queue = [root] if rest[root] else []
        rest[root] = False
        while queue and rest.any():
            at = queue.pop()
            here = rest[owner]
            values, owner = values[here], owner[here]  # what is linked needs no more looks
            mine = sets[at]
            place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
            both = np.bincount(owner[mine[place] == values], minlength=len(nodes))
            hit = np.flatnonzero(rest & (both / np.maximum(size + len(mine) - both, 1) >= share))
            rest[hit] = False
            queue += hit.tolist()
            left += [int(nodes[root])] * len(hit)
            right += nodes[hit].tolist()
    return left, right


def in_blocks(members: DataFrame, sets: DataFrame, share, block: int, stars: Callable = stars) -> DataFrame:
    """members(key, node) of buckets in blocks of about `block` bytes of sets; a task for each two blocks of a key."""

    def both(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        a, b = stars(table.column("node").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")], share)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    bytes_of = sets.select("node", F.octet_length("items").alias("bytes"))
    blocks = members.join(bytes_of, "node").groupBy("key").agg(F.ceil(F.sum(F.col("bytes") + 512) / F.lit(block)).cast("int").alias("n"))
    dealt = members.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", "node", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(both, "a long, b long")


def links(docs: DataFrame, keyed: DataFrame, words: int, share: float, block: int = BLOCK, clash: dict[int, int] | None = None, bits: int = 64) -> DataFrame:
    """docs(text), keyed(node, keys) of distinct nodes -> the components of verified links: node, root."""
    prepare(docs.sparkSession)
    rows = keyed.select("node", F.explode("keys").alias("key"))
    shared = materialise(rows.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("size")).filter("size > 1"))
    members = materialise(rows.join(shared, "key"))
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(members, "node"))
    memo = Words()

    def run(texts):
        out = {"node": [], "items": []}
        for t in texts:
            s = shingles(t, words, memo)
            node = node_of(s, clash or {}, bits)[0]
            if len(s) and in_bitmap(bitmap.value, np.array([node]).view(np.uint64))[0]:
                out["node"].append(node)
                out["items"].append(s.tobytes())
        return out

    sets = materialise(per_document(docs, ["text"], run, "node long, items binary").groupBy("node").agg(F.first("items").alias("items")))
    pairs = members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    edges = materialise(verified(pairs, sets, share))
    roots = components(edges)
    placed = members.filter("size > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    still = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("tag")).filter("low <> high")
    once = still.groupBy("n", "tag").agg(F.min("key").alias("key"))  # bands often have the same bucket
    wide = materialise(placed.join(once.select("key"), "key").select("key", "node"))
    if wide.isEmpty():
        return roots
    return components(edges.unionByName(in_blocks(wide, sets, share, block)))


def near_duplicates(docs: DataFrame, words: int = K, share: float = SHARE, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """docs(doc_id, text) -> one row per document: doc_id, node, component_id.

    component_id is the smallest doc_id reachable over links of a similarity of `share` or more, the
    document's own included. Texts without words (null, empty, blank) are equal to each other and to
    nothing else. Repeated rows stay. A null doc_id stays and counts for no minimum; a component of nulls
    has a null id. An empty table gives an empty result. Other columns are ignored. `bits` is for tests of clashing digests."""
    memo = Words()
    marked, firsts, clash = marked_nodes(docs, lambda text: shingles(text, words, memo), lambda s, node: {"keys": band_keys(s).tolist()}, "keys array<long>", bits)
    roots = links(docs, firsts.select("node", "keys"), words, share, block, clash, bits)
    placed = materialise(firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    ids = materialise(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    # written, so that each join is of plain shuffles and Spark can split a hot node
    found = materialise(placed.join(ids, "root").select("node", "component_id"))
    return marked.select("doc_id", "node").join(found, "node").select("doc_id", "node", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = K, share: float = SHARE) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; all columns are kept.

    Rows that repeat a doc_id count as one document, so one of them stays. Rows without a doc_id
    can't be told apart and all stay. A group is held together by links that each have a similarity of
    `share` or more, so a dropped document is that near to another of its group, not always to the one that stays."""
    return keep_first(docs, near_duplicates(docs, words, share))
