"""S1 / S2: streaming ingestion of turn files into the turn store.

Every micro-batch is appended to the store as one batch of files named after the
stream, its checkpoint and the batch id, so a repeated batch is stored once, and
a stream with another checkpoint adds its own.  With ``dedup`` a turn is stored once:
copies that arrive within ``window`` of each other meet in the stream's state
(``dropDuplicatesWithinWatermark`` on the time of arrival, which is never late, so no
late turn is lost); older ids are looked up in the store by their Bloom filters, and only
batches that may hold one are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embed import hashed_embedding
from ..operators.mutations import insert_turns
from ..schema import TURN_NO_VECTOR
from ..session import materialize
from ..sources.store import TurnStore
from .batches import batch_names


def turn_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming JSON-lines turns with the store schema (no inference)."""
    r = spark.readStream.schema(TURN_NO_VECTOR)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(source_dir)


def once_within(turns: DataFrame, window: str) -> DataFrame:
    """The ``turns`` stream without copies of an id that arrive within ``window`` of its first one; rows without an id all stay."""
    arrived = turns.withColumn("_arrived", F.current_timestamp()).withColumn("_key", F.coalesce(F.col("doc_id"), F.expr("uuid()")))
    return arrived.withWatermark("_arrived", window).dropDuplicatesWithinWatermark(["_key"]).drop("_arrived", "_key")


def unseen(rows: DataFrame, store: TurnStore, batch: str) -> DataFrame:
    """One row per doc_id that no other batch has stored; rows without an id all stay."""
    named = rows.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    stored = store.stored_ids(named.select("doc_id"), but=batch)
    return named.join(stored, "doc_id", "left_anti").unionByName(rows.where(F.col("doc_id").isNull()))


def start_ingest(spark: SparkSession, source_dir: str, store_dir: str, checkpoint: str, as_of: int,
                 dedup: bool = False, embed=hashed_embedding, available_now: bool = True, name: str = "ingest",
                 window: str = "10 minutes") -> StreamingQuery:
    """Append arriving turns, defaults filled, to the ``TurnStore`` at ``store_dir``.

    ``name`` begins the names of this stream's batches; the checkpoint's query id in them
    tells them from those of other streams into the store.
    Without ``dedup`` a repeated doc_id is stored again under a new id.
    """
    store = TurnStore(spark, store_dir).init()
    named = batch_names(spark, checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows, own = insert_turns(batch, as_of), f"{name}-{named(batch_id)}"
        store.append(unseen(materialize(rows), store, own) if dedup else rows, embed, batch=own)

    turns = turn_stream(spark, source_dir)
    q = (once_within(turns, window) if dedup else turns).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
