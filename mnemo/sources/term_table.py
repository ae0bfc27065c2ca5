"""Term counts kept beside a store, so that a sparse model is fitted without reading texts again.

``terms/batch=<name>/bucket=<b>`` holds (doc_id, term, tf) of one append, dealt by term into
buckets so that a look-up of some terms reads their buckets only; ``docs/batch=<name>`` its
documents.  An append writes its own batch (a dynamic partition overwrite), so a repeated one
replaces itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators.sparse import BM25Model, bm25_from_counts
from ..schema import BM25_B, BM25_K1

BUCKETS = 64
TERM_SCHEMA = "doc_id string, term string, tf double, batch string, bucket int"


class TermTable:
    def __init__(self, spark: SparkSession, root: str, tokenizer=tokenize):
        self.spark, self.root, self.tokenizer = spark, root.rstrip("/"), tokenizer

    def append(self, rows: DataFrame, text_col: str = "content", batch: str | None = None) -> TermTable:
        """Count the terms of new ``rows(doc_id, text_col)``; a batch of a known name is replaced."""
        name = batch or uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        tokens = rows.select("doc_id", F.explode(self.tokenizer(F.col(text_col))).alias("term")).withColumn("bucket", bucket)
        # dealt into their buckets once: there they are counted and written
        counts = tokens.repartition("bucket").groupBy("bucket", "doc_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
        for table, df, parts in (("terms", counts.select("doc_id", "term", "tf", F.lit(name).alias("batch"), "bucket"), ["batch", "bucket"]),
                                 ("docs", rows.select("doc_id", F.lit(name).alias("batch")), ["batch"])):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{table}")
        return self

    def terms(self) -> DataFrame:
        """(doc_id, term, tf) of all batches; a filter on terms goes with one on ``bucket`` (``of_terms``)."""
        return self.spark.read.schema(TERM_SCHEMA).parquet(f"{self.root}/terms")

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of a few terms; only their buckets are read."""
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b"))
        buckets = sorted({r.b for r in rows.collect()})
        return self.terms().where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select("doc_id", "term", "tf")

    def docs(self) -> DataFrame:
        return self.spark.read.schema("doc_id string, batch string").parquet(f"{self.root}/docs").select("doc_id")

    def fit(self, k1: float = BM25_K1, b: float = BM25_B) -> BM25Model:
        """The model over all documents appended so far, from their counts."""
        return bm25_from_counts(self.terms().select("doc_id", "term", "tf"), self.docs(), "doc_id", k1, b, written=True)
