"""S3: the conversation report kept up to date by a streaming aggregation.

The stream aggregates counts and last activity per (conversation_id,
document_type) in update mode; each micro-batch's changed keys replace the folder
of their checkpoint and batch id (``foreachBatch``), so a repeated batch leaves
them once.  The current report is the newest row per key, pivoted with the fixed
document-type list (a batch read); ``compact_updates`` folds the log into that.
Of several checkpoints' rows for a key the one written last counts: a new
checkpoint counts anew.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import DOCUMENT_TYPES
from .batches import batch_names


def report_updates(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conversation_id", "document_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("timestamp_max"))


def start_report(turns: DataFrame, updates_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    named = batch_names(turns.sparkSession, checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("written_ms", F.lit(int(time.time() * 1000)))
        rows.write.mode("overwrite").parquet(f"{updates_dir}/batch_id={named(batch_id)}")

    q = (report_updates(turns).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def latest_updates(spark: SparkSession, updates_dir: str) -> DataFrame:
    """Newest ``(n, timestamp_max)`` per (conversation_id, document_type): of each checkpoint by the
    batch id, of those the one written last."""
    return _latest(spark, updates_dir).drop("written_ms")


def _latest(spark: SparkSession, updates_dir: str) -> DataFrame:
    keys = ["conversation_id", "document_type"]
    upd = spark.read.option("mergeSchema", True).parquet(updates_dir)
    if "written_ms" not in upd.columns:  # rows of earlier versions have no time
        upd = upd.withColumn("written_ms", F.lit(0))
    upd = upd.withColumn("batch_id", F.col("batch_id").cast("string")).withColumns({
        "stream": F.regexp_extract("batch_id", r"^(.*?)-?\d+$", 1), "no": F.regexp_extract("batch_id", r"(\d+)$", 1).cast("long"),
        "written_ms": F.coalesce("written_ms", F.lit(0))})
    row = F.struct("n", "timestamp_max", "written_ms")
    of_stream = upd.groupBy(*keys, "stream").agg(F.max_by(row, "no").alias("u"))
    return of_stream.groupBy(*keys).agg(F.max_by("u", F.struct("u.written_ms", "stream")).alias("u")).select(*keys, "u.*")


def compact_updates(spark: SparkSession, updates_dir: str, target_dir: str) -> None:
    """Write the newest row per key as batch 0 of a new log (whatever a stream writes there later is newer)."""
    _latest(spark, updates_dir).write.mode("overwrite").parquet(f"{target_dir}/batch_id=0")


def current_report(spark: SparkSession, updates_dir: str) -> DataFrame:
    """Newest value per (conversation, type), pivoted into the report layout."""
    latest = latest_updates(spark, updates_dir)
    counts = [F.sum(F.when(F.col("document_type") == t, F.col("n")).otherwise(0)).alias(t) for t in DOCUMENT_TYPES]
    return latest.groupBy("conversation_id").agg(*counts, F.max("timestamp_max").alias("timestamp_max"))
