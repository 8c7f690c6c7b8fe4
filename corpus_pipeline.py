"""The corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, token ids.

Each stage works on all that the one before it kept. Null, blank and short texts fail the quality rules; of documents
within 0.75 of one another by word shingles the smallest doc_id stays; documents with a passage of the benchmark go;
the mix repeats or leaves out whole documents by source, null being a source; the last stage writes the
ids of every document left in order of doc_id, each as often as the mix takes it. Rows with a null doc_id pass the join,
rows that share a doc_id stay or go together there. Empty tables pass through every stage. Columns beside doc_id, text and
source are kept up to the last stage, whatever they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intervalia.llm import decontaminate, jaccard_join, mixing, quality_rules, token_ids
from intervalia.llm.common import read_table, saved
from intervalia.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.digests(token_ids.write(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", unlike), ("benchmark decontamination", unleaked), ("mixing", mixed), ("token ids", encoded)]
#: Hash thresholds and a tokenizer are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again as the next one's docs."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
