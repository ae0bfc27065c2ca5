"""S5: recall for every incoming user turn, against a static store snapshot.

Each micro-batch of new user turns becomes a request table; the batch memory
query runs inside ``foreachBatch`` and its ranked rows replace the folder of
their checkpoint and batch id, so a repeated batch leaves them once and results
of other checkpoints stay.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embed import hashed_embedding
from ..operators.memory import memory_query, open_store
from .batches import batch_names


def start_recall(user_turns: DataFrame, store: DataFrame, out_dir: str, checkpoint: str, as_of: int,
                 top_n: int = 8, embed=hashed_embedding, available_now: bool = True) -> StreamingQuery:
    """``user_turns`` stream of ``(doc_id, conversation_id, content)``.  A turn that is
    stored already is asked for with its stored vector, a new one with ``embed(content)``
    (which must give vectors as the store's)."""

    named, packs = batch_names(user_turns.sparkSession, checkpoint), cache(lambda: open_store(store))

    def run(batch: DataFrame, batch_id: int) -> None:
        req = batch.select(
            F.col("doc_id").alias("request_id"), F.lit(None).cast("string").alias("document_type"),
            F.lit(top_n).alias("top_n"), F.lit(0.7).alias("turn_decay"), F.lit(0.7).alias("temporal_decay"),
            F.lit(True).alias("filter_metadocs"), F.lit(as_of).cast("long").alias("as_of"),
            F.col("conversation_id").alias("exclude_conversation_id"))
        texts = batch.select(F.col("doc_id").alias("request_id"), F.lit(0).alias("n"), F.col("content").alias("text"))
        stored = store.select("doc_id", F.col("index").alias("_stored"))
        vecs = batch.join(stored, "doc_id", "left").select(
            F.col("doc_id").alias("request_id"), F.coalesce("_stored", embed(F.col("content"))).alias("qvec"))
        res = memory_query(packs(), req, texts, vecs)
        res.write.mode("overwrite").parquet(f"{out_dir}/batch_id={named(batch_id)}")

    q = user_turns.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
