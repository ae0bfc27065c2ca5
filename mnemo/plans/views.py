"""Deterministic views that turn the driver's tables into the engine's inputs.

``turns`` is a turn store derived from ``conversations`` (+ ``embeddings`` for the
vector); ``chat_requests`` turns every conversation into one recall request
(its user turns are the query texts, newest first); ``session_events`` maps the
``events`` log onto chat actions.  The same expressions appear in the DuckDB
oracle SQL (``mnemo.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dense import mean_vectors
from ..schema import TURN_COLUMNS
from ..sources.tables import read_table

# --- fixed values of the derived test store --------------------------------
BASE_TS = 1704067200        # 2024-01-01 00:00:00 UTC
AS_OF = 1709251200          # 2024-03-01 00:00:00 UTC, later than every turn
# ---------------------------------------------------------------------------


def turns_from_conversations(conv: DataFrame) -> DataFrame:
    c, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    replay = (c % 2 == 1) & (t >= 4)
    conversation_id = F.concat(F.lit("conv-"), c.cast("string"))
    return conv.select(
        F.concat(F.lit("c"), c.cast("string"), F.lit("-"), t.cast("string")).alias("doc_id"),
        F.when((c % 5 == 0) & (role == "assistant"), "journal")
         .when((c % 3 == 0) & (t >= 4), "analysis")
         .when((c % 7 == 0) & (t == 3), "ner-task")
         .when((c % 4 == 0) & (t == 5), "step")
         .otherwise("conversation").alias("document_type"),
        F.concat(F.lit("user"), (c % 10).cast("string")).alias("user_id"),
        F.concat(F.lit("persona"), (c % 3).cast("string")).alias("persona_id"),
        conversation_id.alias("conversation_id"),
        F.when(replay, 1).otherwise(0).cast("int").alias("branch"),
        F.when(replay, t - 2).otherwise(t).cast("int").alias("sequence_no"),
        F.lit("all").alias("listener_id"),
        conversation_id.alias("reference_id"),
        role.alias("role"),
        F.col("text").alias("content"),
        (F.lit(1.0) + (c % 4).cast("double") * 0.1).alias("weight"),
        (F.lit(BASE_TS) + c * 3600 + t * 60).cast("long").alias("timestamp"),
        F.lit("default").alias("inference_model"),
        F.lit(0).cast("int").alias("status"),
        c.alias("conv_id"), t.alias("turn"),
    )


def turns(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    """The turn store. ``with_vectors`` attaches ``index`` (ARRAY<FLOAT>) from ``embeddings``."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    base = turns_from_conversations(conv)
    if not with_vectors:
        return base.select(*TURN_COLUMNS)
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    n_vec = emb.agg(F.count(F.lit(1))).scalar()
    keyed = base.withColumn("vec_id", F.pmod(F.col("conv_id") * 8 + F.col("turn"), n_vec))
    # vec_id is the embeddings key, so this is a many-to-one lookup join; AQE picks
    # broadcast when the vector table is small and sort-merge otherwise
    return (keyed.join(emb, "vec_id", "left")
            .select(*TURN_COLUMNS, F.col("embedding").alias("index")))


def chat_requests(turn_df: DataFrame, as_of: int = AS_OF, top_n: int = 8,
                  turn_decay: float = 0.7, temporal_decay: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """One recall request per conversation: (requests, query_texts).

    Query texts are the conversation's user turns, newest first (``n`` = 0 is the
    newest and weighs most); the conversation itself is excluded from recall.
    """
    users = turn_df.filter(F.col("role") == "user")
    w = Window.partitionBy("conversation_id").orderBy(F.col("timestamp").desc(), F.col("doc_id").desc())
    query_texts = users.select(
        F.col("conversation_id").alias("request_id"),
        (F.row_number().over(w) - 1).cast("int").alias("n"),
        F.col("content").alias("text"),
        F.col("doc_id").alias("source_doc_id"))
    requests = users.select("conversation_id").distinct().select(
        F.col("conversation_id").alias("request_id"),
        F.lit(None).cast("string").alias("document_type"),
        F.lit(top_n).cast("int").alias("top_n"),
        F.lit(float(turn_decay)).alias("turn_decay"),
        F.lit(float(temporal_decay)).alias("temporal_decay"),
        F.lit(True).alias("filter_metadocs"),
        F.lit(as_of).cast("long").alias("as_of"),
        F.col("conversation_id").alias("exclude_conversation_id"))
    return requests, query_texts


def role_texts(turn_df: DataFrame, role: str) -> DataFrame:
    """``(request_id, n, text, source_doc_id)``: a conversation's turns of one role, newest first."""
    rows = turn_df.filter(F.col("role") == role)
    w = Window.partitionBy("conversation_id").orderBy(F.col("timestamp").desc(), F.col("doc_id").desc())
    return rows.select(F.col("conversation_id").alias("request_id"),
                       (F.row_number().over(w) - 1).cast("int").alias("n"),
                       F.col("content").alias("text"), F.col("doc_id").alias("source_doc_id"))


def chats(turn_df: DataFrame, as_of: int = AS_OF) -> DataFrame:
    """One open chat per conversation: ``(request_id, persona_id, conversation_id, as_of)``."""
    return turn_df.select("conversation_id", "persona_id").distinct().select(
        F.col("conversation_id").alias("request_id"), "persona_id", "conversation_id",
        F.lit(as_of).cast("long").alias("as_of"))


def request_vectors(turn_df_with_vectors: DataFrame, query_texts: DataFrame) -> DataFrame:
    """Query vector of a request = the mean of the stored vectors of all its query texts."""
    return mean_vectors(turn_df_with_vectors, query_texts.select("request_id", F.col("source_doc_id").alias("doc_id")))


def personas(turn_df: DataFrame) -> DataFrame:
    """A profile per persona of the store: ``(name, default_location, attributes, features)``."""
    number = F.substring("name", len("persona") + 1, 20)
    return turn_df.select(F.col("persona_id").alias("name")).distinct().select(
        "name", F.concat(F.lit("Room "), number).alias("default_location"), F.create_map(F.lit("age"), F.concat(F.lit("4"), number)).alias("attributes"),
        F.create_map(F.lit("Voice"), F.lit("plain")).alias("features"))


def step_answers(turn_df: DataFrame, steps: int) -> DataFrame:
    """``(request_id, step, text)``: a conversation's assistant turns in a circle serve as the answers to ``steps`` steps;
    every fifteenth conversation (by its number) stops answering at a step of its own."""
    said = turn_df.filter(F.col("role") == "assistant")
    w = Window.partitionBy("conversation_id").orderBy("timestamp", "doc_id")
    n = said.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    told = said.select("conversation_id", "content", (F.row_number().over(w) - 1).alias("i"))
    number = F.substring("conversation_id", len("conv-") + 1, 20).cast("long")
    asked = n.select("conversation_id", "n", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).where(
        ~((number % 15 == 1) & (F.col("step") >= 2 + F.floor(number / 15) % 5)))
    return (asked.withColumn("i", (F.col("step") - 1) % F.col("n")).join(told, ["conversation_id", "i"])
            .select(F.col("conversation_id").alias("request_id"), "step", F.concat(F.lit("Answer "), F.col("step").cast("string"), F.lit(": "), F.col("content")).alias("text")))


# --- fixed values: events -> chat actions -----------------------------------
EVENT_ACTIONS = {"view": "user", "click": "assistant", "error": "back", "purchase": "retry", "signup": "new"}
# ---------------------------------------------------------------------------


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    action = F.when(F.col("event_type") == "view", "user")
    for k, v in EVENT_ACTIONS.items():
        if k != "view":
            action = action.when(F.col("event_type") == k, v)
    return ev.select(F.col("user_id").alias("session"), "ts", "event_id", action.otherwise("new").alias("action"))
