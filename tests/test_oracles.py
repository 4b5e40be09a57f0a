"""A few queries of each area against their SQL in DuckDB; ORACLES=all in the environment takes every one."""

from __future__ import annotations

import decimal
import math
import os
from pathlib import Path

import pytest

import __spark_entry__
from lexiscope.catalog import ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["a13_structural_features", "n8_tokens", "v4_document_scores", "e15_low_fpr_report", "x8_agreement", "d13_quota_decisions", "w2_quota_sample", "j3_audit_provenance", "p7_meaning_signals", "q2_retrieve", "a8_diagnostics", "s12_log_events", "x11_judge_measures", "d15_score_stream", "s14_html_to_paragraphs", "m5_verdict"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_entry_has_rows(spark):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ORACLES") == "all" else SOME)
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
    assert sorted([plain(r[c]) for c in sorted(names)] for r in df.collect()) == want
