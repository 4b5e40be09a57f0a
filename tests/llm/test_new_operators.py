"""Vector codes, bottom-k near-duplicates and importance resampling against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.llm import bottomk, decontam, line_dedup, minhash, resample, vector_codes
from lexiscope.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import edited, frame, groups_of_sets, mixed, prose
from tests.test_oracles import TABLES, plain

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_bottomk"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, cur = QUERIES[name](spark, DATA), con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
    assert sorted([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()) == want


# --- 11 --------------------------------------------------------------------------------------


def codes_by_hand(rows, entries, rounds, parts=4):
    """vec_id -> (code, error, label_error), sha, by full scans in whole numbers of any size."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [[min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for p, x in enumerate(cut(v))] for _, v, _ in kept]
        if n == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), a in zip(kept, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(far(x, books[p][a[p]]) for p, x in enumerate(cut(v))) for (_, v, _), a in zip(kept, at, strict=True)]
    total = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] += e
    top = vector_codes.LONG
    out = {i: ("".join(f"{e:02x}" for e in a), min(d, top), min(total[label], top)) for (i, _, label), a, d in zip(kept, at, errors, strict=True)}
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vectors(rng, n, scale=1.0):
    """Few distinct values, so that there are ties, moved and unmoved entries; some vectors are no vectors."""
    rows = [(i, [rng.choice([-0.5, 0.0, 0.001, 0.25, 0.3]) * scale + rng.choice([0, 0, rng.random()]) for _ in range(8)], rng.choice([0, 1, None])) for i in range(n)]
    odd = [None, [0.1] * 7 + [None], [0.1] * 7 + [math.nan], [math.inf] + [0.0] * 7, [-math.inf] * 8]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)]


@pytest.mark.parametrize("entries, rounds, scale", [(16, 4, 1.0), (5, 2, 1.0), (16, 3, 1e9), (500, 4, 1.0)])
def test_vector_codes_match_full_scans(spark, entries, rounds, scale):
    rows = vectors(random.Random(entries + rounds), 90, scale)
    random.Random(1).shuffle(rows)
    entries = min(entries, 256)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumns({c: F.lit("own") for c in ("code", "dist", "slot", "total", "vec", "error")})
    got = vector_codes.compress(df, entries=entries, rounds=rounds).collect()
    want, sha = codes_by_hand(rows, entries, rounds)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want and len(got) == len(want)
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_unmoved_entries_are_not_scanned_again(monkeypatch):
    """A part whose entry stayed meets the moved ones only, and finds what a full scan finds."""
    rng = np.random.default_rng(3)
    x, book = rng.integers(-50, 50, (200, 4)).astype(float), rng.integers(-50, 50, (12, 4)).astype(float)
    every = np.ones(12, bool)
    code, dist = vector_codes.assign(x, book, every, np.zeros(200, np.int64), np.full(200, -1))
    new = book.copy()
    new[[2, 7]] += 3
    moved = (new != book).any(axis=1)
    seen = []
    real = vector_codes.nearest
    monkeypatch.setattr(vector_codes, "nearest", lambda a, b: seen.append((len(a), len(b))) or real(a, b))
    got = vector_codes.assign(x, new, moved, code, dist)
    assert seen == [(int((~moved[code]).sum()), 2), (int(moved[code].sum()), 12)]
    want = real(x, new)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, "a")], kind)).count() == 0
    rows = [(None, [0.5] * 4, "a"), (2, [0.25] * 4, None), (2, [0.25] * 4, None), (2, [0.0] * 4, "b"), (3, [0.5] * 8, "a"), (4, [3e38] * 4, "a"), (5, [], None)]
    got = sorted(map(str, ((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(spark.createDataFrame(rows, kind)).collect())))
    # codes in the order of the key and then of the vector, a null key last; other lengths and huge components have none
    assert got == sorted(map(str, [(None, "03030303", 0, 0), (2, "01010101", 0, 0), (2, "01010101", 0, 0), (2, "00000000", 0, 0), (3, None, None, 0), (4, None, None, 0), (5, None, None, 0)]))


# --- 12 --------------------------------------------------------------------------------------


def sets_by_hand(texts):
    cut = lambda t: (t or "").encode().lower().split()
    return [{tuple(w[i : i + min(2, len(w))]) for i in range(len(w) - min(2, len(w)) + 1)} if w else set() for w in map(cut, texts)]


def groups_by_hand(texts):
    sets = sets_by_hand(texts)
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root, [len(s) for s in sets]


def small_texts(rng):
    """Sets of 3 to 40 shingles and copies with the last or a middle word changed, so many pairs are just at the bound."""
    out = []
    for n in [*range(3, 24), 30, 41]:
        words = rng.sample([f"w{i}" for i in range(500)], n)
        out.append(" ".join(words))
        for at in (0, n // 2, n - 1, rng.randrange(n)):
            out.append(" ".join([*words[:at], "other", *words[at + 1 :]]))
            out.append(" ".join([*words[:at], *words[at + 1 :]]))
    return out


@pytest.mark.parametrize("block, k, bits", [(2000, bottomk.K, 64), (bottomk.BLOCK, 32, 64), (bottomk.BLOCK, bottomk.K, 3)])
def test_bottomk_matches_brute_force(spark, block, k, bits):
    rng = random.Random(41)
    texts = [*edited(rng), *small_texts(rng), *mixed(), "one", "ONE", "two words", "Two  words"]
    docs = frame(spark, texts).withColumns({c: F.lit(1) for c in ("node", "size", "sketch", "key", "check", "first", "kept", "n_shingles")})
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in bottomk.near_duplicates(docs, k=k, block=block, bits=bits).collect()}
    root, size = groups_by_hand(texts)
    assert got == {i: (root[i], size[i], root[i] == i) for i in range(len(texts))}


def test_linked_sets_always_share_a_list():
    """Every way of leaving shingles out that stays at 0.8 or more, for small sets, and many for larger ones."""
    rng = np.random.default_rng(5)
    for m in [*range(2, 40), 60, 90]:
        most = m - -(-m * 80 // 100)
        for _ in range(200):
            union = np.sort(rng.integers(0, 1 << 63, m, np.uint64))
            gone = rng.choice(m, most, replace=False)
            side = rng.random(most) < rng.random()
            a, b = np.delete(union, gone[side]), np.delete(union, gone[~side])
            if len(a) and len(b) and (a.shape != b.shape or (a != b).any()):
                assert np.intersect1d(bottomk.list_keys(a[: bottomk.K], len(a), bottomk.SHARE), bottomk.list_keys(b[: bottomk.K], len(b), bottomk.SHARE)).size


def test_estimates_of_whole_sketches_are_exact():
    a, b = np.arange(10, 60, dtype=np.uint64), np.arange(20, 70, dtype=np.uint64)
    assert bottomk.estimate(a, b, (50, 50)) == 40 / 60
    assert abs(bottomk.estimate(a[:20], b[:20], (50, 50)) - 10 / 20) < 1e-9  # below 29: 10..29 and 20..29


def test_bottomk_of_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a B c"), (None, None), (2, ""), (3, " \n"), (4, prose(random.Random(2), 30_000)), (5, "x y")]
    got = sorted(map(str, (tuple(r) for r in bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    size = len(sets_by_hand([rows[6][1]])[0])
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False), (2, 0, 2, True), (3, 0, 3, True), (4, size, 4, True), (5, 1, 5, True)]))
    assert bottomk.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bits", [1, 4])
def test_different_sets_with_one_digest_stay_apart(spark, bits):
    """With a digest of a few bits most nodes clash; groups are still those of the sets."""
    texts = edited(random.Random(24), 8)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts), bits=bits).collect()}
    assert [got[i] for i in range(len(texts))] == groups_of_sets(texts)[0]


# --- 13 --------------------------------------------------------------------------------------


def drawn_by_hand(docs, target, buckets=10_000, least=20, share=(5, 100)):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(t):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    rows = [(i, *cut(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in cut(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, n, found in rows:
        h, weight = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16), sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: share[0] * len(able) // share[1]], 1):
        r[4] = rank
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("share", [(5, 100), (30, 100), (1, 1)])
def test_resampling_matches_brute_force(spark, share):
    rng = random.Random(51)
    texts = [*mixed(), *(prose(rng, rng.randint(15, 80)) for _ in range(60)), "Ünï-code 漢字 42 " * 30, "x" * 100_000 + " y" * 30]
    target = [prose(rng, 50) for _ in range(5)] + [None, ""]
    docs = frame(spark, texts).withColumns({c: F.lit("own") for c in ("score", "rank", "line", "weight", "bucket", "n", "own_range", "place")})
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), share=share)
    assert sorted(map(str, map(tuple, got.collect()))) == drawn_by_hand(list(enumerate(texts)), target, share=share)


def test_long_texts_are_cut_without_losing_runs(monkeypatch):
    rng = random.Random(52)
    texts = [prose(rng, 700), None, prose(rng, 3), "", prose(rng, 900)]

    def count():
        memo, all_, words = resample.Crcs(), Counter(), Counter()
        for owner, found, word in resample.features(texts, memo, 1000):
            all_.update(zip(owner.tolist(), found.tolist(), strict=True))
            words.update(word.tolist())
        return all_, words

    whole = count()
    monkeypatch.setattr(resample, "BLOCK", 64)
    assert count() == whole
    monkeypatch.setattr(resample, "KEPT", 5)
    assert count() == whole and whole[1] == Counter({0: 700, 2: 3, 4: 900})


def test_crcs_of_joined_words():
    rng = random.Random(53)
    for _ in range(50):
        a, b = (bytes(rng.choices(range(256), k=rng.choice([0, 1, 3, 17, 300]))) for _ in range(2))
        got = resample.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("ways", [2, 15])
def test_cutoffs_are_found_by_counting(spark, ways):
    rng = random.Random(54)
    values = [rng.choice([-5, 0, 3, 7, rng.randrange(-(1 << 62), 1 << 62)]) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 7, 100, 200):
        top = sorted(values, reverse=True)[n - 1]
        assert resample.cutoff(rows, F.col("v"), n, ways) == (top, sum(v > top for v in values), values.count(top))


def test_resampling_of_ties_and_odd_rows(spark):
    same = "the same words again and again " * 4
    rows = [(7, same)] * 30 + [(None, same)] * 5 + [(8, None), (None, None), (9, "")]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"), share=(1, 2)).collect()
    assert len(got) == 38 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 18))
    assert all((r["n_features"], r["weight"]) == (0, 0) for r in got if r["doc_id"] in (8, 9))
    assert resample.resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")).count() == 0


# --- 5 ---------------------------------------------------------------------------------------


def test_a_shared_opening_makes_no_pairs(spark):
    """300 items and 400 documents begin alike; windows are joined only for candidates."""
    rng = random.Random(61)
    start = "in a small town by the sea there lived"
    items = [f"{start} {prose(rng, 30)}" for _ in range(300)]
    docs = [f"{start} {prose(rng, 40)}" for _ in range(400)]
    docs[7] += " " + items[11]
    items_df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    windows = decontam.item_windows(items_df, decontam.K, decontam.LITERALS)
    told = decontam.telling(windows, decontam.SHARE)
    hot = windows.groupBy("w", "shaped").agg(F.count_distinct("item_id").alias("n")).filter("n > 200")
    assert hot.count() >= 4 and told.join(hot, ["w", "shaped"]).count() == 0
    got = decontam.contaminated(frame(spark, docs), items_df).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in got] == [(7, 11, "verbatim")]


# --- 7 ---------------------------------------------------------------------------------------


def test_the_second_hash_of_a_line_does_not_follow_from_the_first(spark):
    from xxhash import xxh64_intdigest

    keys = [prose(random.Random(i), 9) for i in range(20)]
    for r in spark.createDataFrame([(k,) for k in keys], "k string").select(*line_dedup.line_hashes(F.col("k"))).collect():
        of_h = xxh64_intdigest((1).to_bytes(4, "little"), r["h"] & (1 << 64) - 1)
        assert r["g"] & (1 << 64) - 1 != of_h and r["g"] != r["h"]


def test_lines_of_one_hash_and_different_text_both_stay(spark, monkeypatch):
    real = line_dedup.line_hashes
    monkeypatch.setattr(line_dedup, "line_hashes", lambda key: [F.lit(5).cast("long").alias("h"), real(key)[1]])
    texts = ["a line of this kind\nanother line here", "another LINE here\na third line there", "a third line there"]
    assert [r["text"] for r in line_dedup.dedup_lines(frame(spark, texts), 2, 4).orderBy("doc_id").collect()] == ["a line of this kind\nanother line here", "a third line there", ""]


def test_runs_lie_below_the_shared_folder_and_go(spark, monkeypatch):
    warehouse, shared = (Path(spark.conf.get(k).removeprefix("file:")) for k in ("spark.sql.warehouse.dir", "spark.checkpoint.dir"))
    seen = []
    real = line_dedup.drops
    monkeypatch.setattr(line_dedup, "drops", lambda lines, runs: (real(lines, runs), seen.append(list(runs.folders.values())))[0])
    docs = frame(spark, ["a line of this kind", "A LINE of this kind"])
    assert [r["n_dropped"] for r in line_dedup.dedup_lines(docs, 2, 4).orderBy("doc_id").collect()] == [0, 1]
    paths = [Path(p.removeprefix("file:")) for some in seen for p in some]
    assert paths and all(shared in p.parents and not p.exists() for p in paths)
    assert not list(warehouse.glob("lexiscope_run*"))

    def fails(lines, runs):
        seen.append(runs)
        runs.hashes(lines)
        raise RuntimeError("lost")

    monkeypatch.setattr(line_dedup, "drops", fails)
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dedup_lines(docs, 2, 4)
    assert not seen[-1].folders and not [t for t in spark.catalog.listTables() if t.name.startswith("lexiscope_run")]
