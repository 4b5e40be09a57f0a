"""The ten operators against brute force, exact round trips and held-out accuracy, with empty, null, long and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscope.llm import bpe, decontam, fitting, licenses, line_dedup, minhash, quality_model, quality_rules, records, sharding, simhash, toxicity
from lexiscope.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("an", "the", "or", "is", "re", "tion", "ed", "ing", "ly", "hea") for b in ("st", "nd", "er", "ou", "wh", "ble", "es", "th")]


def frame(spark, texts, start=0):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def mixed(seed=1, n=40):
    """Prose with near copies, repeats, nulls, blanks, marks, other scripts and a long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    near = [" ".join(["other", *t.split()[1:]]) for t in base[:10]]
    lines = ["Shared Line of Text\n" + t for t in base[10:16]] + ["  shared line of TEXT \t\nown line " + t for t in base[16:20]]
    odd = [None, "", " \n\t ", "é É ß 漢字 かな 한국어\nx\n\ny", "a", "Ünïcode ünïcode " * 3, "### !!! $$$", "\x1c\x85\xa0　x", prose(rng, 6000)]
    return base + near + lines + odd + base[:3] + [None, ""]


# --- 1 ---------------------------------------------------------------------------------------


def simhash_by_hand(text, k):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def test_golay_keys_meet_within_two_bits():
    x = np.arange(1 << 11, dtype=np.uint32)  # one word of each coset
    a = simhash.indices(x)
    for e in [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i, j in combinations(range(23), 2))]:
        b = simhash.indices(x ^ np.uint32(e))
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = lambda v: {r: set() for r in range(len(v))} | {r: {k for q, k in zip(*simhash.keys_of(v.view(np.int64)), strict=True) if q == r} for r in range(len(v))}
    kx, ky = keys(x), keys(y)
    assert all(kx[i] & ky[i] for i in range(len(x)))


def test_simhash_matches_brute_force(spark):
    texts = mixed()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    want = [simhash_by_hand(t, 4) for t in texts]
    root = groups_by_hand(want)
    smallest: dict[int, int] = {}
    for i, r in zip(ids, root, strict=True):
        smallest[r] = min(i, smallest.get(r, i))
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, smallest[r]) for i, f, r in zip(ids, want, root, strict=True)}


@pytest.mark.parametrize("hot", [2, 5, 4096])
def test_links_of_dense_buckets(spark, hot):
    """A large group of close fingerprints, with buckets cut into blocks."""
    rng = random.Random(5)
    fps = {0}
    while len(fps) < 60:
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(12))
    fps |= {1 << 40 | 5, rng.getrandbits(63)}
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, hot)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = groups_by_hand(fps)
    mine = [roots.get(f, f) for f in fps]
    assert len(set(zip(want, mine, strict=True))) == len(set(want)) == len(set(mine))


def test_drop_near_duplicates_keeps_one_of_each(spark):
    texts = [prose(random.Random(4), 200)] * 3 + [prose(random.Random(9), 200), None, None]
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(3, prose(random.Random(9), 200), "en", "src0", 1), (None, "x", "en", "s", 1)], SCHEMA))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 0, 3, 4]


def edited(rng, n=60):
    """Texts with copies that have one word in 25 to 100 changed, chains of such copies, and texts that share a half."""
    texts = [prose(rng, rng.randint(60, 400)) for _ in range(n)]
    for t in list(texts):
        for _ in range(rng.choice((1, 1, 2, 6))):
            w = t.split()
            step = rng.choice((25, 35, 50, 100))
            for i in range(rng.randrange(step), len(w), step):
                w[i] = "changed%d" % rng.randrange(10**6)
            texts.append(" ".join(w))
            t = rng.choice((t, texts[-1]))
    half = prose(rng, 150)
    return texts + [f"{half} {prose(rng, 100)}" for _ in range(6)] + ["", None, "a b", "A  b", "a b c"]


def groups_of_sets(texts, words=5, share=0.8):
    """(component of each text, pairs at `share` or more) by brute force over sets of word tuples."""
    cut = lambda t: (t or "").encode().lower().split()
    sets = [{tuple(w[i : i + min(words, len(w))]) for i in range(len(w) - min(words, len(w)) + 1)} if w else {()} for w in map(cut, texts)]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= share]
    root = list(range(len(texts)))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root, pairs


@pytest.mark.parametrize("block", [2000, minhash.BLOCK])
def test_shingle_near_duplicates_match_brute_force(spark, block):
    texts = edited(random.Random(21))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts), block=block).collect()}
    assert [got[i] for i in range(len(texts))] == groups_of_sets(texts)[0]


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    texts = edited(random.Random(22), 20)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups_of_sets(texts)[0]))


def test_buckets_are_searched_whole():
    rng = random.Random(23)
    texts = list(dict.fromkeys(t for t in edited(rng, 12) if t and len(t) > 9))
    sets = [minhash.shingles(t, 5, licenses.Words()) for t in texts]
    a, b = minhash.stars(np.arange(len(texts)), sets, 0.8)
    root = list(range(len(texts)))
    for x, y in zip(a, b, strict=True):
        root[y] = x
    assert root == groups_of_sets(texts)[0]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, 900), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 200 for i in range(201, 261)} | {900: 5}


# --- 2 and 6 ---------------------------------------------------------------------------------


def labelled(spark, bad, n=240, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.5
        words = prose(rng, rng.randint(30, 150)).split()
        rows.append((i, bad(rng, words) if y else " ".join(words)))
        labels.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def insult(rng, words):
    for _ in range(3):
        words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum"])
    return " ".join(words)


def test_toxicity_held_out_and_misspelt(spark):
    docs, labels = labelled(spark, insult)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, table).join(table, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    pos, neg = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    assert sum(p > q for p in pos for q in neg) / len(pos) / len(neg) > 0.95
    bags = toxicity.bags([sorted(toxicity.words_of(r["text"])) for r in docs.orderBy("doc_id").collect()])
    value, _ = toxicity.train(bags, np.array([y for _, y in labels]))
    assert value[toxicity.grams(["idiott"])[0]].mean() > value[toxicity.grams(["therand"])[0]].mean()


def test_quality_model_held_out(spark):
    docs, labels = labelled(spark, lambda rng, words: " ".join(w + "***" for w in words) if rng.random() < 0.5 else " ".join(w for x in words for w in [x] * 5))
    table = spark.createDataFrame([(i, 1 - y) for i, y in labels], "doc_id long, quality int")
    out = quality_model.score(docs, table).join(table, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all((r["score"] >= 0.3) == r["predicted"] for r in out)


def test_toxicity_takes_the_whole_of_long_words():
    for n in (39, 40, 41, 76, 77, 80, 81, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(run)
        assert max(map(len, pieces)) <= toxicity.LONG
        assert all(any(run[i : i + 5] in p for p in pieces) for i in range(n - 4))
    inner = set(toxicity.grams(["罵倒罵倒罵"])[0][1:]) & set(toxicity.grams(["字罵倒罵倒罵字"])[0])
    assert len(inner) >= 3 and inner <= set(toxicity.bags([sorted(toxicity.words_of("字" * 50 + "罵倒罵倒罵" + "字" * 5))])[0][0].tolist())


def test_toxicity_grams_and_scores_in_bulk():
    words = ["a", "ab", "abc", "idiot", "idiots", "ünï", "é" * 40]
    together, of = toxicity.grams(words)
    for n, w in enumerate(words):
        size = len(w) + 2
        assert sorted(together[of == n]) == sorted(toxicity.grams([w])[0])
        assert (of == n).sum() == 1 + sum(size - k + 1 for k in (3, 4, 5) if k < size)
    shared = set(toxicity.grams(["idiot"])[0]) & set(toxicity.grams(["xidiotx"])[0])
    assert len(shared) >= 6 and toxicity.grams([])[0].size == 0
    value = np.random.default_rng(2).standard_normal(1 << toxicity.BITS).astype(np.float32)
    texts = [None, "", *mixed(), "a-b c..d e,f it's; a-b C", "字" * 90 + " x"]
    curve = (np.array([-0.4, 0.0, 0.1, 0.5]), np.array([0.1, 0.2, 0.7, 0.9]))
    scorer = toxicity.Scorer({"value": value, "curve": curve, "none": 0.25})
    for _ in range(2):
        for t, got in zip(texts, scorer(texts), strict=True):
            words = sorted(toxicity.words_of(t))
            margin = np.mean([value[toxicity.grams([w])[0]].mean() for w in words]) if words else 0.0
            slope = 1 / (1 + math.exp(-4 * (margin - 0.05) / 0.9))
            want = 0.99 * np.interp(margin, *curve) + 0.01 * slope if words else 0.25
            assert got == pytest.approx(want, abs=1e-5)


def test_shares_by_pools():
    """Shares rise with the margin, and few margins far out don't bend them."""
    margin = np.array([-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 500.0, 900.0])
    y = np.array([0, 0, 1, 0, 1, 1, 1, 1])
    at, share = fitting.monotone(margin, y, np.ones(8))
    assert at.tolist() == [-2.5, -0.5, 350.75]  # no toxic one, one of two, all
    assert (np.diff(share) >= 0).all() and (np.diff(fitting.share_at(np.linspace(-9, 950, 400), (at, share))) > 0).all()
    weighted = fitting.monotone(np.zeros(4), np.array([1, 0, 0, 0]), np.array([3.0, 1, 1, 1]))
    assert weighted[1].tolist() == [0.5]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_classifiers_take_odd_rows(spark, module, label):
    docs = frame(spark, [None, "", "x", " "]).unionByName(spark.createDataFrame([(None, "y", "en", "s", 1), (1, "", "en", "s", 0)], SCHEMA)).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    out = module.score(docs, none).collect()
    assert len(out) == 6 and all(r["score"] == pytest.approx(0.5, abs=0.01) for r in out)
    one = spark.createDataFrame([(2, 1), (None, 0), (3, None)], f"doc_id long, {label} int")
    assert all(0 <= r["score"] <= 1 for r in module.score(docs, one).collect())
    assert module.score(docs.limit(0), one).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.r_[rng.integers(10, 60, 8), [1 if i % 2 else 2]]).astype(np.int32) for i in range(80)]
    y = np.arange(80) % 2
    model = quality_model.fit(rows, y, {0: 1.0, 1: 1.0})
    assert all((quality_model.predict(model, r) > 0.5) == t for r, t in zip(rows, y, strict=True))


# --- 3 ---------------------------------------------------------------------------------------


def base_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_matches_brute_force(spark):
    texts = mixed() + ["Licensed under CC BY-NC 4.0. MIT License; mit-license. GNU  General\nPublic License", "apacheé license Apache License apache license", "K license mit license", "cc", "mit"]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_hand(t)
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_license_template_with_edits(spark):
    label, text = licenses.TEMPLATES[1]
    words = text.split()
    edited = " ".join([*words[:8], "indeed", *words[8:]])
    r = {x["doc_id"]: x for x in licenses.scan(frame(spark, ["intro words here " + edited + " and more", "nothing to see", " ".join(words[:6])])).collect()}
    assert r[0]["labels"] == label and r[0]["base_labels"] == "" and len(r[0]["spans"]) == 1 and r[0]["spans"][0]["low"] == 3
    assert r[1]["labels"] == r[2]["labels"] == ""


# --- 4 ---------------------------------------------------------------------------------------


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] >= 2 for j in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(hit)


def test_quality_counts_match_brute_force(spark):
    texts = mixed() + ["a b c a b c d", "x\nx\n x\n\n\n", "the the the the", "a b", "one two three " * 50]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality_rules.judge(frame(spark, texts), labels).collect():
        want = counts_by_hand(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_binomial_bound_is_exact():
    for k, n, alpha in ((0, 50, 0.05), (3, 100, 0.01), (40, 60, 0.001)):
        p = quality_rules.upper_bound(k, n, alpha)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(alpha, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.1) == 1.0


def test_certified_rules_keep_their_promise():
    """Over many holdouts, the chance that the certified set rejects more than `risk` of good documents is within alpha."""
    rng, risk, alpha, n = np.random.default_rng(3), 0.05, 0.1, 200
    rates = np.array([0.0, 0.01, 0.03, 0.045, 0.055, 0.06, 0.1, 0.3])  # of good documents that each set would reject
    broken = held = 0
    for _ in range(1500):
        u = rng.random(n)
        first = Counter(int(x) for x in np.searchsorted(rates, u, side="left") if x < len(rates))
        last = quality_rules.last_certified(first, n, len(rates), risk, alpha)
        held += last > 0
        broken += last > 0 and rates[last - 1] > risk
    assert held == 1500 and 0 < broken / 1500 <= alpha


def test_steps_reject_many_bad_documents_for_a_good_one():
    counts = {(0, 3.0): (50, 0), (0, 2.0): (80, 1), (0, 1.0): (90, 60), (1, 0.5): (40, 2), (1, 0.9): (0, 0)}
    assert quality_rules.path(counts, gain=3) == [(0, 3.0), (0, 2.0), (1, 0.5)]
    assert quality_rules.path({}, gain=3) == [] and quality_rules.last_certified({}, 0, 3, 0.5, 0.5) == 0


def test_rules_are_certified_and_reject(spark):
    rng = random.Random(8)
    good = [prose(rng, 60) for _ in range(120)]
    bad = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(80)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(200)], "doc_id long, quality int")
    docs = frame(spark, texts).withColumn("measures", F.lit("m")).withColumn("stratum", F.lit(3)).withColumn("rejected_by", F.lit(4)).withColumn("__text", F.lit(5))
    out = {r["doc_id"]: r for r in quality_rules.judge(docs, labels, risk=0.1, delta=0.1).collect()}
    assert all(out[i]["kept"] for i in range(120)) and not any(out[i]["kept"] for i in range(120, 200))
    assert {x for i in range(120, 200) for x in out[i]["rejected_by"]} >= {"symbol_ratio"}
    assert all(r["kept"] for r in quality_rules.judge(docs, labels, risk=0.001).collect())  # too few labels for the bound
    more = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id in (5, 150)").withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string")}))
    kept = quality_rules.keep_good(more, labels, risk=0.1, delta=0.1)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows) == sorted([-1, -1, 3, *range(120)])  # a null language has no labels of its own
    assert {(r["measures"], r["stratum"], r["rejected_by"], r["__text"]) for r in rows} == {("m", 3, 4, 5)}
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None} == dict(enumerate(good))


def test_rules_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(frame(spark, []), none).count() == 0 and quality_rules.keep_good(frame(spark, []), none).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", "en"), (1, "a " * 60, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert [r["kept"] for r in quality_rules.judge(odd, labels).collect()] == [False] * 3


# --- 5 ---------------------------------------------------------------------------------------


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_decontamination_finds_copies_and_leaves_clean_text(spark):
    rng = random.Random(10)
    items = [prose(rng, 30).capitalize() + "." for _ in range(5)] + [None, ""]
    docs = [prose(rng, 200) for _ in range(10)] + [f"{prose(rng, 50)} {items[2].upper()} {prose(rng, 40)}", items[3], None, "", items[4][: len(items[4]) // 4], " ".join(items[0].split()[:20])]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(frame(spark, docs), items_of(spark, items)).collect()}
    assert got == {(10, 2): "verbatim", (11, 3): "verbatim", (15, 0): "verbatim"}
    clean = decontam.drop_contaminated(frame(spark, docs), items_of(spark, items))
    assert sorted(r["doc_id"] for r in clean.collect()) == [*range(10), 12, 13, 14]


def test_reparameterised_copies_need_consistent_slots(spark):
    item = "A train with 12 cars leaves the station and meets Alice after 30 minutes while 12 people wait for Alice at the other end of town"
    same = item.replace("12", "99").replace("30", "45").replace("Alice", "Robert")
    mixed_up = item.replace("12", "99", 1).replace("30", "45").replace("Alice", "Robert", 1)
    got = {r["doc_id"]: r["kind"] for r in decontam.contaminated(frame(spark, [same, mixed_up, item]), items_of(spark, [item]), k=6, share=0.9).collect()}
    assert got == {0: "reparameterised", 2: "verbatim"}


def test_slots_are_consistent_within_an_occurrence(spark):
    item = "A train with 12 cars leaves the station and meets Alice after 30 minutes while 12 people wait for Alice at the other end of town"
    one, two = item.replace("12", "99").replace("Alice", "Robert"), item.replace("12", "7").replace("30", "45")
    inserted = two.replace("minutes while", "minutes of very slow and quite boring travel while")
    far = prose(random.Random(12), 400)
    docs = [
        f"{one}. {two}.",
        f"{far} {one} {far} {two} {far}",
        f"{one} {far} a train with 12 cars leaves the station",
        item.replace("12", "7").replace("30", "7"),
        f"{inserted} {far} meets Alice after 31 minutes while 13 people wait for Bob",
        item.replace("12", "99", 1).replace("30", "45"),
        f"{far} a train with 12 cars leaves the station {far}",
    ]
    got = {r["doc_id"]: r["kind"] for r in decontam.contaminated(frame(spark, docs), items_of(spark, [item]), share=0.6).collect()}
    assert got == dict.fromkeys(range(5), "reparameterised")


def test_decontamination_passes_over_lone_marks(spark):
    item = "When the first train, full of guests, left town: nobody stayed. Was it late, or early? The old guard, alone, knew; he said nothing, and slept."
    spaced = re.sub(r"([.,;:!?])", r" \1 ", item)
    dashed = " - ".join(item.split()) + " *"
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["share"]) for r in decontam.contaminated(frame(spark, [spaced, dashed, item]), items_of(spark, [item, spaced])).collect()}
    assert got == {(d, i): ("verbatim", 1.0) for d in range(3) for i in range(2)}
    a, b = decontam.Canon([item], decontam.Memo()), decontam.Canon([". " + spaced], decontam.Memo())
    assert a.template.tolist() == b.template.tolist() and a.slot.tolist() == b.slot.tolist()


def test_short_items_are_found_whole(spark):
    items = ["Who wrote the famous book?", "Why not?", "Yes", "where is the old town", None]
    docs = ["They asked who wrote the famous book, then left.", "who wrote the famous", "why not", "and why not now", "yes!", "yes yes", "Where is the old town", "where is town old the", "", None]
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["first_word"], r["last_word"]) for r in decontam.contaminated(frame(spark, docs), items_of(spark, items)).collect()}
    assert got == {(0, 0): ("verbatim", 2, 6), (2, 1): ("verbatim", 0, 1), (4, 2): ("verbatim", 0, 0), (6, 3): ("verbatim", 0, 4)}


def found_by_hand(docs, items, k=6, share=0.4, literals=3, slack=4):
    """doc, item -> kind, by plain loops over windows."""

    def words(text):
        out, end = [], True
        for c in (text or "").split():
            bare = re.sub(r"^\W+|\W+$", "", c)
            if bare:
                low = bare.lower()
                kind = "<n>" if low in decontam.NUMBER_WORDS or decontam.NUMBER.fullmatch(low) else "<u>" if low in decontam.UNITS else "<c>" if bare[0].isupper() and len(bare) > 1 and not end else None
                out.append((low, kind))
                end = False
            if c[-1] in ".!?:;" and out:
                end = True
        return out

    def windows(ws, n):
        for p in range(len(ws) - n + 1):
            part = ws[p : p + n]
            yield p, False, tuple(w for w, _ in part), part
            if n == k and any(t for _, t in part) and sum(t is None for _, t in part) >= literals:
                yield p, True, tuple(t or w for w, t in part), part

    found = {}
    for d, text in enumerate(docs):
        dw = words(text)
        for i, item in enumerate(items):
            iw = words(item)
            if not iw or (len(iw) < 3 and len(dw) != len(iw)):
                continue
            n = min(k, len(iw))
            total = max(len(iw) - k + 1, 1)
            own = {}
            for pos, shaped, key, part in windows(iw, n):
                own.setdefault((shaped, key), []).append((pos, part))
            hits = [(p, shaped, pos, part, want) for p, shaped, key, part in windows(dw, n) for pos, want in own.get((shaped, key), ())]
            lanes = sorted({p - pos for p, _, pos, _, _ in hits})
            groups = [[*lanes]] + [[x] for x in lanes]
            for gap in (total, slack):
                run = []
                for x in lanes:
                    if run and x - run[-1] > gap:
                        groups.append(run)
                        run = []
                    run.append(x)
                groups.append(run)
            enough = lambda c: c >= 2 and c >= share * total or c == total
            for g in groups:
                inside = [h for h in hits if h[0] - h[2] in g]
                maps = {(w[0], x[0]) for _, shaped, _, part, want in inside if shaped for w, x in zip(want, part, strict=True) if w[1]}
                if g == lanes and enough(len({h[2] for h in inside if not h[1]})):
                    found[d, i] = "verbatim"
                elif enough(len({h[2] for h in inside})) and len(maps) == len({a for a, _ in maps}):
                    found.setdefault((d, i), "reparameterised")
    return found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(31)
    base = ["A train with 12 cars leaves the old town and meets Alice after 30 minutes while 12 people wait for Alice", "If Bob has 3 apples and buys 5 kg more then how many apples does Bob have left", "The capital of France is the city of Paris and it lies on a river", "when did it start"]
    items = [*base, base[1].replace("apples", "pears"), None, ""]

    def change(t):
        for a, b in rng.sample([("12", "7"), ("30", "45"), ("Alice", "Robert"), ("Bob", "Ann"), ("3 ", "9 "), ("5 ", "9 "), ("Paris", "Lyon"), ("the ", "the very "), ("and ", "- and , ")], 3):
            t = t.replace(a, b, rng.choice([1, 5]))
        return t

    docs = [None, "", "Start."]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = change(rng.choice(base))
            if rng.random() < 0.3:
                w = t.split()
                t = " ".join(w[rng.randrange(len(w)) :])
            parts += [t + rng.choice([".", "", " !"]), prose(rng, rng.choice([0, 3, 40]))]
        docs.append(" ".join(parts))
    docs += docs[5:8]
    for share in (0.4, 0.7):
        got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(frame(spark, docs).withColumn("w", F.lit(1)).withColumn("item_id", F.lit("x")), items_of(spark, items), share=share).collect()}
        assert got == found_by_hand(docs, items, share=share)
        assert len(set(got.values())) == 2


def test_decontamination_takes_repeated_rows_and_equal_items(spark):
    text = "the quick old dog of the house sleeps near the warm fire all day"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(9, text), (4, text), (None, "nothing of it at all in here today")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()] == [(1, 4)]
    assert sorted(str(r["doc_id"]) for r in decontam.drop_contaminated(docs, items).collect()) == ["2", "None"]


def test_decontamination_of_empty_tables(spark):
    docs, items = frame(spark, ["a b c d e f g h"]), items_of(spark, ["a b c d e f g h"])
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == 1


# --- 7 ---------------------------------------------------------------------------------------


def lines_by_hand(rows):
    blank, out, owner = " \t\n\x0b\x0c\r", {}, {}
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(blank))
    holders: dict[str, set] = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(low(x), set()).add(i)
    owner = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) >= 2}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(low(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup_matches_brute_force(spark, batches):
    texts = mixed() + ["ÄHNLICHE ZEILE HIER\nÄHNLICHE zeile HIER", "Ähnliche Zeile hier\nÄHNLICHE ZEILE hier", "dup dup dup dup\ndup dup dup dup", "\n\n\n", "Shared Line of Text"]
    docs = frame(spark, texts).withColumn("n_lines", F.lit("clash")).orderBy(F.desc("doc_id"))
    out = line_dedup.dedup_lines(docs, batches, buckets=4).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("sha"))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == lines_by_hand(list(enumerate(texts)))


def test_line_dedup_of_empty_and_null_ids(spark):
    assert line_dedup.dedup_lines(frame(spark, []), 3, 4).count() == 0
    docs = spark.createDataFrame([(None, "the same long line"), (4, "the same long line\nx"), (4, "the same long line\nx")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(docs, 2, 4).collect()) == ["", "the same long line\nx", "the same long line\nx"]


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(spark, 2)
    for i in range(7):
        runs.add(spark.createDataFrame([(i, i, i)], "h long, g long, owner long"))
    assert {k: len(v) for k, v in runs.levels.items()} == {0: 1, 1: 2} and runs.merges == 2
    assert sorted(r["h"] for t in runs.tables() for r in t.collect()) == list(range(7))
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexiscope_run")]


def test_runs_are_read_as_they_lie(spark):
    """No shuffle and no sort between the hashes of a batch and the runs, nor when runs are merged."""
    runs = line_dedup.Runs(spark, 4)
    rows = [spark.range(2000 * i, 2000 * i + 3000).select(F.lit(i).cast("long").alias("doc_id"), F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("g")) for i in range(3)]
    runs.add(spark.table(runs.hashes(rows[0])))
    runs.add(runs.fresh(spark.table(runs.hashes(rows[1]))))
    found = spark.table(runs.hashes(rows[2]))
    with line_dedup.sorted_buckets(spark):
        for df in (runs.fresh(found), runs.seen(found)[1], line_dedup.merged(runs.tables())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert runs.fresh(found).count() == 2000 and [x.count() for x in runs.seen(found)] == [0, 1000]
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    runs.close()


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a line of some length\nx", 5, 6, 7, "p"), (2, "A LINE of some length\ny", 5, 6, 7, "q"), (2, None, 5, 6, 7, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, th int, n_lines int, kept string")
    out = line_dedup.dedup_lines(docs, counts=False)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a line of some length\nx", 5, 6, 7, "p"), (2, "", 5, 6, 7, "r"), (2, "y", 5, 6, 7, "q")]


# --- 8 ---------------------------------------------------------------------------------------


def shards_by_hand(rows, n):
    recs = sorted((hashlib.md5((t or "").encode()).hexdigest(), i if i is not None else -(1 << 63), i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, out, used = sum(r[3] for r in recs), 0, [], Counter()
    for _, _, i, size, crc in recs:
        s = at * n // total
        out.append((i, size, crc, "bytes", s, used[s], None))
        used[s] += 1
        at += size
    return out


@pytest.mark.parametrize("ranges, short", [(1, 256), (8, 256), (60, 256), (60, 3)])
def test_shards_match_brute_force(spark, monkeypatch, ranges, short):
    monkeypatch.setattr(sharding, "SHORT", short)
    rows = [(i, t) for i, t in enumerate(mixed() + ["hot"] * 90)] + [(None, "x"), (3, "again"), (3, "again")]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24, ranges, 4).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(shards_by_hand(rows, 24), key=key)


def test_shards_of_an_empty_table(spark):
    assert sharding.shards(frame(spark, [])).count() == 0


# --- 9 ---------------------------------------------------------------------------------------


def odd_texts(n=3000):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "a", "B", "the", "'s", "'ll", "1", "23", "é", "É", "漢字", "!", ".", ",", "##", "ing", "tion", "😀", "\xa0", "İ", "Σ", "é", "É", "̸", "²", "_", "\x00", "ǅ", "thethe", "aaaa"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


def test_byte_bpe_equals_the_library():
    import public_tokenizers as P
    import tiktoken

    c = bpe.coder()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for t in odd_texts() + [x or "" for x in mixed()] + ["z" * 5000, "ab" * 3000, "<|endoftext|>"]:
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_byte_bpe_query_columns(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = mixed()
    for r in bpe.digests(frame(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode(frame(spark, [])).count() == 0


# --- 10 --------------------------------------------------------------------------------------


def word_file():
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def ids_of(coder, texts, end=None):
    import pyarrow as pa

    return [np.frombuffer(x, "<u2").tolist() for x in coder.encode(pa.array(texts, pa.string()), end).to_pylist()]


def library_ids(text):
    return records.word_coder().tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_chunks_equal_the_library():
    texts = odd_texts() + ["<|endoftext|> x<|startoftext|>!", "It's a TEST, isn't it?!...", "a<|endoftext|>b. <|end <|endoftext|>... a<|startoftext|>.", "new-ish%%% newish%%% é&&& ***x***", None]
    own = records.WordCoder(word_file())
    for some in (texts, texts[::-1]):  # with an empty and a full memo
        assert ids_of(own, some) == [library_ids(t) for t in some]
    plain = [t for t in texts if not t or not any(c in t for c in records.SEPARATORS)]
    assert ids_of(own, plain) == [library_ids(t) for t in plain]
    assert ids_of(own, plain, 1) == [[*library_ids(t), 1] for t in plain] and ids_of(own, []) == [] and ids_of(own, [None, ""], 1) == [[1], [1]]


def test_word_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(records, "KEPT", 50)
    own = records.WordCoder(word_file())
    for t in mixed() * 2:
        assert ids_of(own, [t]) == [library_ids(t)]


def test_a_tokenizer_that_cuts_otherwise_gets_whole_texts(tmp_path):
    import json

    with open(word_file(), encoding="utf-8") as f:
        whole = json.load(f)
    whole["normalizer"] = None  # upper case is no longer folded, so neither may the memo
    path = tmp_path / "own.json"
    path.write_text(json.dumps(whole), encoding="utf-8")
    own = records.WordCoder(str(path))
    texts = ["A TEST of Case", "a test of case", ""]
    assert not own.chunked and ids_of(own, texts) == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_round_trip(spark, tmp_path):
    texts = mixed()
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5), (3, "again", "en", "s", 5)], SCHEMA)).repartition(4)
    written = records.write_records(docs, str(tmp_path / "out"), file_bytes=2000, least=20_000)
    files = written.collect()
    assert len({r["part"] for r in files}) > 1 and max(r["seq"] for r in files) > 0
    assert records.read_records(written, str(tmp_path / "out")).rdd.getNumPartitions() == len(files)
    got = sorted(records.read_records(written, str(tmp_path / "out")).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids"][-4:] == b"\x01\0\0\0"
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and len(ids) == len(texts) + 2
    want = Counter((i, tuple([*library_ids(t), 1])) for i, t in [*enumerate(texts), (None, "no id"), (3, "again")])
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want


def test_records_tell_damage_and_read_in_any_order(tmp_path):
    w = records.Writer(str(tmp_path), "part", "0")
    rows = [(i, np.arange(i, i + 5, dtype="<u4").tobytes()) for i in range(4)] + [(None, np.array([70000], "<u4").tobytes())]
    for i, ids in rows:
        w.add(i, np.frombuffer(ids, "<u4"))
    w.close()
    assert list(records.read_file(str(tmp_path), "part")) == rows
    assert list(records.read_file(str(tmp_path), "part", np.array([4, 0, 2]))) == [rows[4], rows[0], rows[2]]
    path = tmp_path / "part.rec"
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        list(records.read_file(str(tmp_path), "part"))


def test_records_of_many_equal_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(7, "the same words", "x", 1, 2)] * 300 + [(8, "others", "y", 1, 2)], "doc_id long, text string, ids string, wide int, tie int")
    got = records.round_trip(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == {(7, 4): 300, (8, 2): 1}
    assert sorted(r["start"] for r in got) == list(range(0, 1201, 4))


def test_records_of_an_empty_table(spark):
    assert records.round_trip(frame(spark, [])).count() == 0


def test_each_license_template_is_told_from_the_others(spark):
    texts = [f"{prose(random.Random(n), 40)} {text} {prose(random.Random(n + 99), 40)}" for n, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: {x["label"] for x in r["spans"]} for r in licenses.scan(frame(spark, texts)).collect()}
    families = ({"gpl", "lgpl", "agpl"}, {"cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd"})
    for n, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[n] and all(x == label or any({x, label} <= f for f in families) for x in got[n]), (label, got[n])
