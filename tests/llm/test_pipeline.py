"""The pipeline and its stages against brute force, with odd rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiscope.llm import licenses, minhash
from tests.llm.test_operators import SCHEMA, counts_by_hand, edited, found_by_hand, frame, groups_of_sets, lines_by_hand, mixed, prose

BENCH = ["A train with 12 cars leaves the old town and meets Alice after 30 minutes while 12 people wait for Alice", "If Bob has 3 apples and buys 5 kg more then how many apples does Bob have left in the end"]


def texts():
    rng = random.Random(41)
    leaks = [f"{prose(rng, 80)} {BENCH[0].replace('12', '7').replace('Alice', 'Robert')}. {prose(rng, 30)}", f"{prose(rng, 70)} {BENCH[1]}"]
    again = prose(rng, 90)
    shared = "\n".join(["A line that many documents share", prose(rng, 60)])
    lines = [f"{shared}\n{prose(rng, 70)}" for _ in range(3)] + [f"A LINE that many documents share \n{again}", again + "\n  a line that many documents share"]
    return mixed() + edited(rng, 12) + leaks + lines + [leaks[0], prose(rng, 3000)]


def dropped_lines(rows):
    """(doc_id, text) without repeated lines; lines_by_hand() checks the digests elsewhere."""
    blank, holders = " \t\n\x0b\x0c\r", {}
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(blank))
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(low(x), set()).add(i)
    owner = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) >= 2}
    out = [(i, "\n".join(x for x in (t or "").split("\n") if owner.get(low(x), i) == i)) for i, t in rows]
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in out} == {i: v[2] for i, v in lines_by_hand(rows).items()}
    return out


def by_hand(rows):
    """doc_id -> (n_tokens, digest of the decoded bytes) by way of all stages, without labels."""
    import base64

    import public_tokenizers as P
    import tiktoken

    good = [(i, t) for i, t in rows if (n := counts_by_hand(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]]
    good = dropped_lines(good)
    root, _ = groups_of_sets([t for _, t in good])
    good = [x for n, x in enumerate(good) if root[n] == n]
    found = {d for d, _ in found_by_hand([t for _, t in good], BENCH)}
    assert found
    good = [x for n, x in enumerate(good) if n not in found]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: (len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in good}


def tables(spark, folder, docs, labels=()):
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = list(enumerate(texts()))
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, frame(spark, [t for _, t in rows])))
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in out.collect()}
    assert got == by_hand(rows) and len(got) > 20


CLASHES = ["id", "at", "th", "drop", "kept", "stratum", "measures", "rejected_by", "n_lines", "n_dropped", "n_words", "component_id", "node", "item_id", "w", "__id", "__text"]


def test_stages_keep_rows_columns_and_odd_values(spark, tmp_path):
    rng = random.Random(42)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 90)
    rows = [(1, a, "en"), (1, a, "en"), (None, b, None), (None, b, "en"), (4, c, None), (5, None, None), (None, None, "en"), (6, f"{c} one more", "de"), (7, f"{prose(rng, 60)} {BENCH[1]}", "en")]
    docs = spark.createDataFrame([(*r, "s", 9) for r in rows], SCHEMA).withColumns({n: F.lit(f"own {n}") for n in CLASHES})
    folder = tables(spark, tmp_path, docs, [(1, 1, 0), (None, 0, 1), (4, None, None)])
    kept = {"quality_rules": 7, "line_dedup": 9, "near_duplicates": 7, "decontamination": 8}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        got = out.collect()
        assert len(got) == kept[name], name
        assert all(r[n] == f"own {n}" for r in got for n in CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, folder).collect()) == ["1", "4", "None", "None"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = tables(spark, tmp_path, frame(spark, []))
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the given tables are not here")
def test_near_duplicates_of_a_whole_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    holders, sets, memo = {}, [], licenses.Words()
    for n, r in enumerate(rows):
        sets.append(set(minhash.shingles(r["text"], 5, memo).tolist()))
        for x in sets[-1]:
            holders.setdefault(x, []).append(n)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for n, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for m in holders[x]:
                if m < n:
                    shared[m] = shared.get(m, 0) + 1
        for m, k in [*shared.items(), *((m, 0) for m in range(n) if not s and not sets[m])]:
            if not s or k / (len(s) + len(sets[m]) - k) >= 0.8:
                pairs += sets[m] != s
                x, y = sorted((find(m), find(n)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert pairs > 5 and got == {r["doc_id"]: rows[find(n)]["doc_id"] for n, r in enumerate(rows)}
