"""Near-duplicates by the exact Jaccard similarity of word shingles, with bottom-k sketches for candidates.

A document is its set of distinct shingle hashes, and its sketch the K smallest of them: one hash function. Retained
values lie in inverted lists under runs of up to four neighbours in the order of the hash, as a single common word
pair would put a third of all documents into one list. In the sorted union of two sets of m shingles, x of which
they don't share, the shared ones fall into at most x + 1 runs, so one run has ceil((m - x) / (x + 1)) of them at
least, and these are neighbours in both sets. At a similarity of 0.8 that is four from 16 shingles on, three from 6,
two at 5; below that linked sets are equal. A set is listed under runs of each length that a partner may need, so lists
lose no link of sets up to K shingles. Of a larger one the runs of its sketch serve: at a similarity of 0.8 no run of
four among K = 96 values is shared with a probability of some 0.8^96, 5e-10.

Lists propose, and the pairs of a list are never listed:
* each member against the smallest one: the sketch of the union estimates their similarity (for small sets exactly), and what comes
  within six deviations of the bound is verified by the whole sets;
* lists whose members these links don't hold together are searched whole, in blocks of a bounded size."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import components, in_bitmap, key_bitmap, materialise, per_document, rolling
from lexiscope.llm.licenses import Words
from lexiscope.llm.minhash import BLOCK, in_blocks, marked_nodes, node_of, shingles
from lexiscope.session import discard, prepare

WORDS, SHARE, K, RUN = 2, (80, 100), 96, 4
#: How far below the bound an estimate may fall: six standard deviations of a share of 0.8 among K.
SLACK = 0.25


# --- sketches --------------------------------------------------------------------------------


@cache
def runs_for(n: int, share: tuple[int, int]) -> tuple[int, ...]:
    """The lengths of runs that a set of n shingles needs so that it meets every partner: one for each size of a union."""
    lengths = set()
    for m in range(n, n * share[1] // share[0] + 1):
        x = m - -(-m * share[0] // share[1])  # the most that two sets of this union don't share
        if x:
            lengths.add(min(RUN, -(-(m - x) // (x + 1))))
    return tuple(sorted(lengths))


def list_keys(sketch: np.ndarray, n: int, share: tuple[int, int], k: int = K) -> np.ndarray:
    """The distinct keys (int64) of the inverted lists of a set of n shingles, from its sketch."""
    lengths = runs_for(min(n, 4 * k), share)  # from there on, all are RUN
    return np.unique(np.concatenate([rolling(sketch, r) + np.uint64(r) for r in lengths])).view(np.int64) if lengths else np.zeros(0, np.int64)


def least(share: tuple[int, int]) -> float:
    return share[0] / share[1] - SLACK


def estimate(a: np.ndarray, b: np.ndarray, sizes: tuple[int, int]) -> float:
    """The similarity of two sets by the part of their sketches' union below which both are whole; exact if both sketches are."""
    ends = [s[-1] for s, n in zip((a, b), sizes, strict=True) if len(s) < n]
    if ends:
        top = min(ends)
        a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def near(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether whole sets are linked, in whole numbers."""
    small, large = sorted((len(x), len(y)))
    if share[1] * small < share[0] * large or not small:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return share[1] * both >= share[0] * (len(x) + len(y) - both)


def stars(nodes: np.ndarray, sets: list[np.ndarray], share: tuple[int, int], k: int = K) -> tuple[list[int], list[int]]:
    """The components of distinct nodes under their links, as edges (first, other): sketches choose whom to compare."""
    size = np.array([len(s) for s in sets], np.int64)
    sketch = [s[:k] for s in sets]
    held = np.minimum(size, k)
    top = np.array([s[-1] if len(s) < n else np.iinfo(np.uint64).max for s, n in zip(sketch, size, strict=True)], np.uint64)
    values, owner = np.concatenate(sketch), np.repeat(np.arange(len(sets)), held)
    whole, start = np.concatenate(sets), np.cumsum(size) - size
    left, right, rest = [], [], np.ones(len(nodes), bool)

    def linked(at: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose whole sets are linked with one."""
        n = size[others]
        place = np.repeat(start[others] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        among = whole[place]
        found = np.minimum(np.searchsorted(sets[at], among), size[at] - 1)
        both = np.bincount(np.repeat(np.arange(len(others)), n)[sets[at][found] == among], minlength=len(others))
        return others[share[1] * both >= share[0] * (n + size[at] - both)]

    for root in range(len(nodes)):
        queue = [root] if rest[root] else []
        rest[root] = False
        while queue and rest.any():
            at = queue.pop()
            here = rest[owner]
            values, owner = values[here], owner[here]  # what is linked needs no more looks
            mine = sketch[at]
            limit = np.minimum(top, top[at])
            place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
            both = np.bincount(owner[mine[place] == values], minlength=len(nodes))
            below = np.bincount(owner[values <= limit[owner]], minlength=len(nodes)) + np.searchsorted(mine, limit, "right")
            # between sets that are whole in their sketches the estimate is the similarity itself
            enough = np.where(np.maximum(size, size[at]) <= k, share[0] / share[1] - 1e-9, least(share))
            fits = (share[1] * np.minimum(size, size[at]) >= share[0] * np.maximum(size, size[at])) & (both >= enough * np.maximum(below - both, 1))
            hit = linked(at, np.flatnonzero(rest & fits))
            rest[hit] = False
            queue += hit.tolist()
            left += [int(nodes[root])] * len(hit)
            right += nodes[hit].tolist()
    return left, right


# --- links -----------------------------------------------------------------------------------


def proposed(pairs: DataFrame, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """pairs(a, b), sketches(node, size, sketch) -> those whose estimate comes near the bound."""
    low = least(share)

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for i in range(batch.num_rows):
                close = share[1] * min(n[i], m[i]) >= share[0] * max(n[i], m[i])
                keep.append(close and estimate(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5)), (n[i], m[i])) >= low)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    side = lambda node, size, sketch: sketches.select(F.col("node").alias(node), F.col("size").alias(size), F.col("sketch").alias(sketch))
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """pairs(a, b), sets(node, items) -> those that are linked."""

    def run(batches):
        for batch in batches:
            keep = [near(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3)), share) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    side = lambda node, items: sets.select(F.col("node").alias(node), F.col("items").alias(items))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, firsts: DataFrame, clash: dict[int, int], words: int, share: tuple[int, int], k: int = K, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """docs(text), firsts(node, size, sketch) of distinct sets -> the components of verified links: node, root."""
    spark = prepare(docs.sparkSession)

    def lists(batches):
        for batch in batches:
            keys = [list_keys(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64), n, share, k) for i, n in enumerate(batch.column(1).to_pylist())]
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), size))], ["key", "node"])

    rows = firsts.select("node", "size", "sketch").mapInArrow(lists, "key long, node long")
    rows = materialise(rows)
    shared = materialise(rows.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("size")).filter("size > 1"))
    members = materialise(rows.join(shared, "key"))
    discard(rows)
    discard(shared)
    near_low = materialise(proposed(members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), firsts, share))
    wanted = members.filter("size > 2").select("node").unionByName(near_low.select(F.col("a").alias("node"))).unionByName(near_low.select(F.col("b").alias("node")))
    wanted = wanted.distinct().join(firsts.select("node", F.xxhash64("first").alias("of")), "node")
    bitmap, ids_of = (spark.sparkContext.broadcast(key_bitmap(wanted, c)) for c in ("node", "of"))
    memo = Words()

    def run(ids, texts):
        from xxhash import xxh64_intdigest

        out = {"node": [], "items": []}
        # xxhash64() of a long is that of its eight bytes; of a null it is the seed, so texts without an id are cut if there is such a node
        hashes = np.array([42 if i is None else xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) for i in ids], np.uint64)
        for t in [texts[i] for i in np.flatnonzero(in_bitmap(ids_of.value, hashes)).tolist()]:
            s = shingles(t, words, memo)
            node = node_of(s, clash, bits)[0]
            if len(s) and in_bitmap(bitmap.value, np.array([node]).view(np.uint64))[0]:
                out["node"].append(node)
                out["items"].append(s.tobytes())
        return out

    sets = materialise(per_document(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], run, "node long, items binary").groupBy("node").agg(F.first("items").alias("items")))
    edges = materialise(verified(near_low, sets, share))
    # a label is the smallest node two links away: nodes of one label are connected, which is all that is needed to leave a list out
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select("of", F.least("of", "m").alias("m"))
    labels = both.join(one, F.col("b") == F.col("of")).groupBy(F.col("a").alias("node")).agg(F.min("m").alias("root"))
    placed = members.filter("size > 2").join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    still = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("tag")).filter("low <> high")
    once = still.groupBy("n", "tag").agg(F.min("key").alias("key"))  # several lists often hold the same sets
    wide = materialise(placed.join(once.select("key"), "key").select("key", "node"))
    if wide.isEmpty():
        return components(edges)
    return components(edges.unionByName(in_blocks(wide, sets, share, block, stars)))


def near_duplicates(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, k: int = K, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept for every row.

    A text's set are its distinct shingles of `words` words, A-Z lower-cased; a text of fewer words is one shingle.
    component_id is the smallest doc_id reachable over links of a similarity of share[0] / share[1] or more, its own
    included; kept says that it is its own. Texts without words (null, empty, blank) have no shingles and no
    links, not even with each other. Repeated rows stay. A null doc_id stays, counts for no minimum and is
    never kept; a component of nulls has a null id. An empty table gives an empty result. Other columns are ignored.
    `bits` is for tests of clashing digests."""
    memo = Words()

    def run(s, node):
        return {"n_shingles": len(s), "sketch": s[:k].tobytes()}

    marked, firsts, clash = marked_nodes(docs, lambda text: shingles(text, words, memo), run, "n_shingles long, sketch binary", bits)
    full, none = marked.filter("n_shingles > 0"), marked.filter("n_shingles = 0")
    firsts = firsts.filter("n_shingles > 0").withColumnRenamed("n_shingles", "size")
    roots = links(docs, firsts, clash, words, share, k, block, bits)
    placed = materialise(firsts.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    ids = materialise(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    # written, so that each join is of plain shuffles and Spark can split a hot node
    found = materialise(placed.join(ids, "root").select("node", "component_id"))
    out = full.select("doc_id", "n_shingles", "node").join(found, "node").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def oracle(table: str = "documents", share: tuple[int, int] = SHARE) -> str:
    """The rows of op12 in SQL: all pairs of different sets that share a shingle, and what is reachable."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from {table}),
s as (select doc_id, list_sort(list_distinct(case when len(w) < 2 then w else list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from t),
n as materialized (select row_number() over (order by min(doc_id)) as node, min(doc_id) as first, s from s where len(s) > 0 group by s),
i as materialized (select node, len(s) as size, unnest(s) as g from n),
e as materialized (select a.node as a, b.node as b from i a join i b on a.g = b.g and a.node <> b.node group by a.node, b.node, a.size, b.size having {share[1]} * count(*) >= {share[0]} * (a.size + b.size - count(*))),
r(node, root) as (select node, node from n union select e.b, r.root from r join e on r.node = e.a where r.root < e.b),
c as (select r.node, min(n.first) as component_id from r join n on r.root = n.node group by r.node)
select s.doc_id, len(s.s) as n_shingles, coalesce(c.component_id, s.doc_id) as component_id, coalesce(c.component_id, s.doc_id) = s.doc_id as kept
from s left join n on s.s = n.s left join c on c.node = n.node"""
