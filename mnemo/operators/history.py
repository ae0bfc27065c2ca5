"""Branch-aware conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import derive_date, derive_speaker
from ..schema import COLUMNS, DOC_ANALYSIS, DOC_STEP

HISTORY_ORDER = ["timestamp", "branch", "sequence_no"]
HISTORY_BLOCK_SECONDS = 86400


def latest_branch_history(turns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keep the rows whose branch is the newest one for their sequence number.

    A window max over (conversation keys, sequence_no): one shuffle on the
    conversation keys, no self-join.  A conversation is bounded by its turns.
    """
    keys = keys or ["conversation_id"]
    w = Window.partitionBy(*keys, "sequence_no")
    return turns.withColumn("_max_branch", F.max("branch").over(w)).filter(
        F.col("branch") == F.col("_max_branch")).drop("_max_branch")


def blocked_position(df: DataFrame, keys: list[str], order: list[str], block: Column,
                     name: str = "pos") -> DataFrame:
    """1-based position of each row within ``keys`` by ``order``, without a window
    keyed by ``keys`` alone: rows are numbered inside (keys, block) and shifted by
    the row counts of the earlier blocks (a window over the small per-block count
    table).  ``block`` must be non-decreasing along ``order`` (e.g. a time bucket
    of the leading timestamp), so a hot key is spread over its blocks.
    """
    b = df.withColumn("_blk", block)
    local = F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(*[F.col(c) for c in order]))
    counts = b.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).drop("_cnt")
    return (b.withColumn("_loc", local).join(offsets, [*keys, "_blk"])
            .withColumn(name, (F.col("_off") + F.col("_loc")).cast("int")).drop("_blk", "_loc", "_off"))


def std_projection(df: DataFrame, time_zone: str = "UTC", extra: list[str] | None = None) -> DataFrame:
    return df.select(*(extra or []), *COLUMNS, derive_date("timestamp", time_zone).alias("date"),
                     derive_speaker().alias("speaker"))


def conversation_history(store: DataFrame, conversations: DataFrame | None = None,
                         filter_text: str | Column | None = None, keys: list[str] | None = None,
                         time_zone: str = "UTC") -> DataFrame:
    """History of each selected conversation, newest branch per sequence number,
    ordered by (timestamp, branch, sequence_no) as ``pos``.

    ``conversations`` (the key columns) restricts the output through a semi join;
    ``None`` returns every conversation.
    """
    keys = keys or ["conversation_id"]
    df = store
    if conversations is not None:
        df = df.join(conversations.select(*keys).distinct(), keys, "left_semi")
    if filter_text is not None:
        df = df.filter(filter_text)
    kept = latest_branch_history(df, keys)
    # positions by (timestamp, branch, sequence_no, doc_id); day blocks of the
    # timestamp keep a very long conversation from landing in one task
    ordered = blocked_position(kept, keys, HISTORY_ORDER + ["doc_id"],
                               F.floor(F.col("timestamp") / HISTORY_BLOCK_SECONDS))
    return std_projection(ordered, time_zone, extra=["pos"])


# rows kept by the vector search of a history lookup with a query text
HISTORY_QUERY_LIMIT = 100


def conversation_history_for_query(store: DataFrame, queries: DataFrame, limit: int = HISTORY_QUERY_LIMIT,
                                   time_zone: str = "UTC") -> DataFrame:
    """History lookup with a query text: per ``queries(request_id, conversation_id,
    qvec)`` the ``limit`` rows of that conversation nearest to the query vector,
    then the newest branch per sequence number and the history order.

    A request meets the rows of its own conversation only: an equi-join, a native
    distance, and a top-``limit`` per request (trimmed before the shuffle)."""
    from .dense import squared_l2
    asked = queries.select("request_id", "conversation_id", "qvec")
    met = (store.where(F.col("index").isNotNull()).join(asked, "conversation_id")
           .withColumn("_distance", squared_l2(F.col("index"), F.col("qvec"))))
    nearest = Window.partitionBy("request_id").orderBy("_distance", "doc_id")
    rows = (met.withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= limit)
            .drop("_rank", "_distance", "index", "qvec"))
    kept = latest_branch_history(rows, ["request_id"])
    w = Window.partitionBy("request_id").orderBy(*[F.col(c) for c in HISTORY_ORDER], F.col("doc_id"))
    # at most ``limit`` rows per request: a bounded window
    return std_projection(kept.withColumn("pos", F.row_number().over(w)), time_zone, extra=["request_id", "pos"])


def display_lines(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``role: content`` line per history row; ``keys`` name the conversation (three columns
    where conversation ids repeat across users or personas)."""
    return history.select(*(keys or ["conversation_id"]), "pos", F.concat_ws(": ", "role", "content").alias("line"))


def non_final_steps(store: DataFrame) -> DataFrame:
    """Analysis rows that are not the last of their (conversation, type, branch)."""
    a = store.filter(F.col("document_type") == DOC_ANALYSIS)
    w = Window.partitionBy("conversation_id", "document_type", "branch")
    return (a.withColumn("_max_seq", F.max("sequence_no").over(w))
            .filter(F.col("sequence_no") < F.col("_max_seq")).drop("_max_seq"))


def retype_documents(store: DataFrame) -> DataFrame:
    """Rewrite of the store where the non-final analysis rows become ``step``.

    Only analysis rows are joined, with one aggregate row per (conversation, branch);
    all others pass through unshuffled.
    """
    is_analysis = F.coalesce(F.col("document_type") == DOC_ANALYSIS, F.lit(False))
    analysis, keys = store.filter(is_analysis), ["conversation_id", "branch"]
    last = analysis.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("sequence_no").alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    typed = analysis.join(last, same).withColumn("document_type", F.when(F.col("sequence_no") < F.col("_last"), F.lit(DOC_STEP))
                                                 .otherwise(F.col("document_type")))
    return store.filter(~is_analysis).unionByName(typed.select(*store.columns))
