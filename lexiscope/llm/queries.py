"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.llm import bottomk, bpe, decontam, licenses, line_dedup, quality_model, quality_rules, records, resample, sharding, simhash, toxicity, vector_codes
from lexiscope.session import table


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_model(spark, sf_dir):
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"), n=24)


def op10_records(spark, sf_dir):
    return records.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_bottomk(spark, sf_dir):
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"))


def op13_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_quality_model": op6_quality_model,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_records": op10_records,
    "op11_vector_codes": op11_vector_codes,
    "op12_bottomk": op12_bottomk,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {"op7_line_dedup": line_dedup.oracle(), "op11_vector_codes": vector_codes.oracle(), "op12_bottomk": bottomk.oracle()}
