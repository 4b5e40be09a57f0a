"""Every operator over rows that repeat, without ids or texts, with columns named as its own, and over no rows at all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiscope.llm import bpe, decontam, licenses, line_dedup, minhash, quality_model, quality_rules, records, sharding, simhash, toxicity
from tests.llm.test_operators import prose

CLASH = "fp node component_id first root key row hits base w p pos label template labels spans k d size r before shard slot ids n_tokens wide tie part start a b m stratum measures rejected_by n_words h g th at drop lost kept owner q low high score held_out predicted y toxic quality item_id lane id n share kind _text".split()
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, under the MIT License"
LONG = prose(random.Random(3), 30_000)
ROWS = [(1, MIT, "en"), (1, MIT, "en"), (None, MIT, None), (None, None, "en"), (2, "", "fr"), (3, LONG, None), (4, f"{MIT}\nThe same long line here", "en"), (5, "the SAME long line here", "en")]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None), (5, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(7, MIT), (8, None), (None, ""), (9, "no such words are anywhere in these texts")], "item_id long, text string")


OPERATORS = {
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "quality_rules": lambda s, d: quality_rules.judge(d, labels(s)),
    "quality_model": lambda s, d: quality_model.score(d, labels(s)),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "sharding": lambda s, d: sharding.shards(d),
    "bpe": lambda s, d: bpe.encode(d),
    "records": lambda s, d: records.round_trip(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit(f"own {c}") for c in CLASH})
    rows = OPERATORS[name](spark, docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, *_ in ROWS)
    equal = [{c: r[c] for c in r.asDict() if c not in ("row", "slot", "start")} for r in rows if r["doc_id"] == 1]
    assert equal[0] == equal[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_results_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["labels"], r["n_base"], r["n_words"]) for r in licenses.scan(docs).filter("doc_id is not null").collect()}
    assert found[1] == ("mit", 1, len(MIT.split())) and found[2] == ("", 0, 0) and found[3] == ("", 0, 30_000) and found[4][0] == "mit"
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items(spark)).collect()) == [(1, 7), (4, 7)]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    assert groups[1] == 1 and groups[2] == 2  # a null text and an empty one are equal, but a null id is no smallest id
    assert decontam.contaminated(docs.limit(0), items(spark)).count() == 0 and decontam.contaminated(docs, items(spark).limit(0)).count() == 0
