"""The corpus pipeline: from documents to token ids.

quality_rules drops documents that the hard rules or the fitted trees reject; simhash keeps one
document of each near-duplicate group; decontamination drops documents that overlap with a
benchmark item; pii replaces personal data in the texts; bpe_encoding gives the token ids of what
is left, and the digest of the text that they decode to. Every stage but the last returns the columns of documents; each works
on all that the one before kept. Null texts have no words, so the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, decontam, pii, quality_gbt, simhash
from loomgraph.llm.common import materialize, table
from loomgraph.llm.queries import BPE_FILE, TOKENIZERS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    return quality_gbt.keep(docs, quality_gbt.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(COLUMNS))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, f"{TOKENIZERS}/{BPE_FILE}", decoded=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", redact_pii),
    ("bpe_encoding", bpe_encoding),
]
#: Fitted trees and byte-pair merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
