"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.llm.common import stage
from mnemo.llm.decontaminate import decontaminate
from mnemo.llm.jaccard import jaccard_components
from mnemo.llm.line_dedup import line_dedup
from mnemo.llm.packing import pack
from mnemo.llm.queries import WORD_BPE, table
from mnemo.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = COLUMNS[2:]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't call toxic."""
    return toxicity(docs, table(spark, sf_dir, "labels"), keep=REST).where("predicted = 0").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated chunks of lines."""
    return line_dedup(docs, keep=REST).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id; documents without an id all stay.
    Of rows that share an id the one with the smallest text stays."""
    docs = docs.select(*COLUMNS)
    heads = stage(jaccard_components(docs).where("component_id = doc_id").select("doc_id").distinct(), "group-heads")
    order = Window.partitionBy("doc_id").orderBy("text", "lang", "source")
    kept = docs.join(heads, "doc_id", "left_semi").withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=REST).where("NOT contaminated").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("jaccard_join", jaccard_stage),
          ("decontamination", decontaminate_stage), ("packing", packing_stage)]

#: The network and the tokenizer are beyond SQL: see tests/llm for the brute-force comparison.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, stage(docs, f"pipeline-{i}") if i else docs, sf_dir)
    return docs
