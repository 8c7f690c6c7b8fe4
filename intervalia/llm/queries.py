"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervalia.llm import arc_warc, centroid_clusters, decontaminate, jaccard_join, license_scan, mixing, piece_codes, piece_counts, quality_rules, runs, secret_scan, suffix_dedup, token_ids
from intervalia.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.digests(token_ids.write(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = arc_warc.read(spark, arc_warc.convert(spark, arc_warc.write_arc(read_table(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_jaccard_join, op2_source_mixing, op3_token_ids, op4_arc_to_warc, op5_secret_scan, op6_decontamination, op7_license_scan, op8_quality_rules, op9_token_counts, op10_suffix_dedup, op11_centroid_clusters, op12_piece_codes, op13_word_runs]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clusters": centroid_clusters.sql()}
