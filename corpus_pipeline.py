"""From raw documents to a training mix: five stages, each one operator over all that the stage before it kept.

1. quality rules: documents that the current policy rejects go;
2. MinHash near-dedup: of each class of near copies the document with the smallest doc_id stays;
3. substring dedup: passages of 13 words and more that a document with a smaller doc_id has too are cut;
4. benchmark decontamination: documents that hold a benchmark question, also with other numbers or names, go;
5. mixing: documents and their copies that make up the target weights.

The order puts the cheap per-document filter first and the pairwise one before the passage one, so that whole copies
are gone before passages are exchanged; decontamination sees the texts as they will be trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from secscan.llm import bagminhash, block_anchors, decontaminate, quality_rules, queries
from secscan.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_anchors.clean_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.mix_documents(docs)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]

#: near-duplicate classes need signatures and components, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
