"""Store analytics: counts, pivot report, pending work, branch and resume positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_READ_LIMIT, DOC_ANALYSIS, DOC_CONVERSATION, DOCUMENT_TYPES


def store_size(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n_rows"))


def list_conversations(store: DataFrame) -> DataFrame:
    """Messages per (document_type, user_id, persona_id, conversation_id), sorted by keys."""
    keys = ["document_type", "user_id", "persona_id", "conversation_id"]
    return store.groupBy(*keys).agg(F.count(F.lit(1)).alias("messages")).orderBy(*keys)


def type_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("document_type", "conversation_id").agg(F.count(F.lit(1)).alias("n"))


def last_activity(store: DataFrame) -> DataFrame:
    return store.groupBy("conversation_id").agg(F.max("timestamp").alias("timestamp_max"))


def conversation_report(store: DataFrame) -> DataFrame:
    """One row per conversation: a count column per known document type + last activity.

    The pivot is written as conditional counts over a fixed type list in one
    grouped aggregate (partial aggregation map-side, one shuffle, stable schema;
    ``groupBy().pivot()`` plus a join with the max would shuffle twice).
    """
    counts = [F.count(F.when(F.col("document_type") == t, 1)).alias(t) for t in DOCUMENT_TYPES]
    return (store.groupBy("conversation_id").agg(*counts, F.max("timestamp").alias("timestamp_max"))
            .orderBy("timestamp_max", "conversation_id"))


def pending_analysis(store: DataFrame) -> DataFrame:
    """Conversations with conversation turns and no analysis, oldest activity first.

    The first row is the next one to analyse (``next_pending``).  Written as a
    grouped aggregate with conditional counts: one shuffle, no join; the queue is
    ordered by a distributed range sort, never numbered in a single task.
    """
    per = store.groupBy("conversation_id").agg(
        F.sum(F.when(F.col("document_type") == DOC_CONVERSATION, 1).otherwise(0)).alias("n_conversation"),
        F.sum(F.when(F.col("document_type") == DOC_ANALYSIS, 1).otherwise(0)).alias("n_analysis"),
        F.max("timestamp").alias("timestamp_max"))
    pending = per.filter((F.col("n_conversation") > 0) & (F.col("n_analysis") == 0))
    return pending.select("conversation_id", "timestamp_max").orderBy("timestamp_max", "conversation_id")


def next_pending(store: DataFrame) -> DataFrame:
    """The oldest pending conversation (a per-task top-1 and one merge)."""
    return pending_analysis(store).limit(1)


def next_branch(store: DataFrame, keys: DataFrame) -> DataFrame:
    """``max(branch) + 1`` per (document_type, user_id, persona_id, conversation_id), 0 if none."""
    k = ["document_type", "user_id", "persona_id", "conversation_id"]
    mx = store.groupBy(*k).agg(F.max("branch").alias("max_branch"))
    return keys.select(*k).join(mx, k, "left").select(
        *k, F.coalesce(F.col("max_branch") + 1, F.lit(0)).cast("int").alias("next_branch"))


def resume_position(history: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """Per conversation, where a resumed chat continues: the last row by
    (date, sequence_no, branch) gives next sequence_no = last + 1 and its branch.
    With ``chats(conversation_id)`` there is a row for each of these, 0 and 0 for one without history."""
    last = history.groupBy("conversation_id").agg(
        F.max_by(F.struct("sequence_no", "branch"), F.struct("date", "sequence_no", "branch")).alias("last"))
    if chats is not None:
        last = chats.select("conversation_id").distinct().join(last, "conversation_id", "left")
    return last.select("conversation_id", F.coalesce(F.col("last.sequence_no") + 1, F.lit(0)).cast("int").alias("next_sequence_no"),
                       F.coalesce(F.col("last.branch"), F.lit(0)).cast("int").alias("branch"))


def get_where(store: DataFrame, predicate, sort_columns: list[str] | None = None,
              limit: int = DEFAULT_READ_LIMIT) -> DataFrame:
    """Rows matching a SQL predicate / Column, sorted descending, at most ``limit``.

    The sort runs before the limit (TakeOrderedAndProject: a per-task top-n then
    one merge), so the kept rows are well defined.
    """
    df = store.where(predicate)
    if sort_columns:
        df = df.orderBy(*[F.col(c).desc() for c in sort_columns], F.col("doc_id").asc())
    return df.limit(limit)


def abbreviate_columns(df: DataFrame, width: int = 2) -> DataFrame:
    """Report headers cut to ``width`` characters; repeated short names get ``_2``,
    ``_3``... (Spark forbids usable duplicate column names)."""
    seen: dict[str, int] = {}
    cols = []
    for c in df.columns:
        short = c[:width]
        seen[short] = seen.get(short, 0) + 1
        name = short if seen[short] == 1 else f"{short}_{seen[short]}"
        cols.append(F.col(f"`{c}`").alias(name))
    return df.select(*cols)
