"""A corpus pipeline of five stages over documents; each reads what the one before it kept, as Parquet.

Rejected by the quality classifier: gone. Near-duplicates: one row of each group stays, of the smallest id (see
near_dedup.one_of_each). Leaks of benchmark items: gone. Secrets: replaced by a mark, n_chars follows. What is
left is encoded.

Null and empty texts pass every stage, and very long ones are taken whole. Rows of one id and different texts are
documents of their own; of repeated rows one is left by near_dedup, but those without words all stay. Leaks go by
id: rows that share the id of a leak go with it. Columns beyond those of documents are handed on, whatever their
names; encoding replaces columns named ids and n_tokens. Where the classifier has too few labels to learn from
(less than two rows of one of the classes outside the held-out fold), it rejects nothing. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, near_dedup, quality_classifier, secrets, sentencepiece_codec
from sievework.llm.common import read, staged
from sievework.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, length="n_chars", repo=F.concat_ws("/", "source", "lang"), owner="source")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(docs.drop("n_tokens"), vocabulary("piece_bpe_32k.model"), decoded=None)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality), ("near_dedup", near_duplicates), ("decontamination", decontamination),
    ("secrets", secret_scan), ("sentencepiece", encoding)
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
