"""Hybrid memory query for many requests at once.

``requests(request_id, document_type, top_n, turn_decay, temporal_decay,
filter_metadocs, as_of, exclude_conversation_id)`` with ``query_texts(request_id,
n, text)`` (``n`` = position, weighs ``turn_decay ** n``), one query vector per
request and optional ``exclusions(request_id, doc_id)``.

Per request: prefilter -> exclusion -> the 1000 nearest vectors -> BM25 fitted on
those candidates -> best decayed similarity -> score -> top n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import derive_date, derive_speaker, memory_score
from ..session import materialize
from ..schema import CANDIDATE_LIMIT, COLUMNS, DOC_JOURNAL, MEMORY_WINDOW, META_DOCUMENT_TYPES, RECALL_SIZE
from .block_scores import SCORED_SCHEMA, block_scores
from .dense import blocks_of, find_nearest, nearest_requests, reachable
from .recall_store import RecallStore, drop_folder
from .sparse import hashed_tokens

# broadcast bound for the ranked rows joined back onto the store scan
MAX_BROADCAST_CANDIDATES = 2_000_000
# broadcast bound for the requests' parameters
MAX_BROADCAST_QUERY_TEXTS = 200_000

RESULT_COLUMNS = COLUMNS + ["date", "speaker", "score"]


def _checked_broadcast(df: DataFrame, bound_rows: int, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when a proven row bound is under ``max_rows``."""
    return F.broadcast(df) if bound_rows <= max_rows else df


def open_store(store: DataFrame, filter_text=None) -> RecallStore:
    """A store for several calls whose requests ask for all document types but metadocs."""
    return RecallStore(store, filter_text, ~F.coalesce(F.col("document_type").isin(*META_DOCUMENT_TYPES), F.lit(False)))


def memory_query(store: DataFrame | RecallStore, requests: DataFrame, query_texts: DataFrame, query_vectors: DataFrame,
                 exclusions: DataFrame | None = None, filter_text=None, k: int = CANDIDATE_LIMIT,
                 time_zone: str = "UTC", with_distance: bool = False) -> DataFrame:
    """Ranked memories ``(request_id, rank, COLUMNS..., date, speaker, score)``.

    ``store`` is the turn table with its ``index`` vectors; ``filter_text`` is a
    global SQL predicate / Column applied to the store before the vector search
    (it reaches the Parquet scan).  A ``RecallStore`` serves several calls; its own filter holds then.
    """
    # a request without a vector (no query text) searches from the origin
    requests = materialize(requests)
    req = requests.join(query_vectors, "request_id", "left")
    packs = store if isinstance(store, RecallStore) else RecallStore(store, filter_text, reachable(requests))
    if exclusions is not None:
        # what a request must not find, by number: a search is widened by as many rows, so that this leaves it k
        gone = exclusions.select("request_id", "doc_id").distinct().join(packs.codes(), "doc_id")
        req = req.join(gone.groupBy("request_id").agg(F.collect_list("code").alias("left_out")), "request_id", "left")
    req = materialize(nearest_requests(req, k))
    n_req, most = requests.agg(F.count(F.lit(1)), F.coalesce(F.max(F.coalesce("top_n", F.lit(2 ** 31 - 1))), F.lit(2 ** 31 - 1))).first()
    n_blocks = blocks_of(packs.spark, n_req * k)
    found = find_nearest(packs, req, k, n_blocks)

    # BM25 is fitted on each request's own candidate set; each document is tokenized once, in its pack
    texts = query_texts.select("request_id", "n", "text")
    params = requests.select("request_id", "turn_decay", "temporal_decay", "as_of", "top_n")
    params = _checked_broadcast(params, n_req, MAX_BROADCAST_QUERY_TEXTS)
    asked = texts.join(params.select("request_id", "turn_decay"), "request_id").select(
        "request_id", F.pow(F.col("turn_decay"), F.col("n").cast("double")).alias("weight"), hashed_tokens(F.col("text")).alias("tokens"))
    has_texts = texts.select("request_id").distinct().withColumn("has_texts", F.lit(True))
    folder = block_scores(packs, found, asked, params, n_blocks)
    drop_folder(packs.spark, found)
    scored = (packs.spark.read.schema(SCORED_SCHEMA).parquet(folder)
              .join(params.select("request_id", "temporal_decay", "as_of", "top_n"), "request_id")
              .join(has_texts, "request_id", "left"))
    best_sim = F.when(F.col("has_texts"), F.coalesce(F.col("best_sim"), F.lit(0.0))).otherwise(F.lit(1.0))
    scored = scored.withColumn("score", memory_score(best_sim, "distance", "weight", "clen",
                                                     "temporal_decay", "timestamp", "as_of"))
    w = Window.partitionBy("request_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    # no request wants more than ``most``, so a task sends no more of one
    ranked = (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
              .filter(F.col("top_n").isNull() | (F.col("rank") <= F.col("top_n")))
              .select("request_id", "doc_id", "rank", "score", "distance", "timestamp"))
    ranked = materialize(ranked)
    drop_folder(packs.spark, folder)
    if not isinstance(store, RecallStore):
        packs.close()
    # output columns for the kept rows only (bounded by requests x the most that one wants)
    full = packs.rows.select(*COLUMNS).join(_checked_broadcast(ranked, n_req * min(most, k), MAX_BROADCAST_CANDIDATES), "doc_id")
    out = [F.col("request_id"), F.col("rank")] + [F.col(c) for c in COLUMNS] + [
        derive_date("timestamp", time_zone).alias("date"), derive_speaker().alias("speaker"), F.col("score")]
    if with_distance:
        out.append(F.col("distance"))
    return full.select(*out)


def hash_uniform(key, seed: int = 0):
    """Reproducible uniform in [0, 1) from a key: the first 52 bits of md5(key:seed).

    Portable (any SQL engine with md5 gives the same numbers) and independent
    of partitioning, unlike ``rand()``.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def conscious_sample(store: DataFrame, personas: DataFrame, seed: int = 0, time_zone: str = "UTC") -> DataFrame:
    """Journal entries of each persona ranked by a seeded ``uniform * weight``.

    ``personas(request_id, persona_id, top_n)``; ``top_n`` null keeps all.
    """
    # the score doesn't depend on the request: rank once per persona, down to the largest
    # top_n asked of it, before any request is joined
    wanted = personas.groupBy("persona_id").agg(F.max(F.coalesce("top_n", F.lit(2 ** 31 - 1))).alias("_most"))
    journal = store.filter(F.col("document_type") == DOC_JOURNAL).withColumn("score", hash_uniform("doc_id", seed) * F.col("weight"))
    most = personas.agg(F.max(F.coalesce("top_n", F.lit(2 ** 31 - 1)))).scalar()
    w = Window.partitionBy("persona_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    ranked = (journal.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.coalesce(most, F.lit(0)))
              .join(wanted, "persona_id").filter(F.col("rank") <= F.col("_most")).drop("_most"))
    ranked = (ranked.join(personas.select("request_id", "persona_id", "top_n"), "persona_id")
              .filter(F.col("top_n").isNull() | (F.col("rank") <= F.col("top_n"))))
    return ranked.select("request_id", "rank", *COLUMNS, derive_date("timestamp", time_zone).alias("date"),
                         derive_speaker().alias("speaker"), "score")


def recall_bundle(store: DataFrame, chats: DataFrame, assistant_texts: DataFrame, assistant_vectors: DataFrame,
                  user_texts: DataFrame, user_vectors: DataFrame, memory_window: int = MEMORY_WINDOW,
                  recall_size: int = RECALL_SIZE, as_of: int | None = None, seed: int = 0,
                  time_zone: str = "UTC", packs: RecallStore | None = None) -> DataFrame:
    """The memories of one chat turn, for many chats at once.

    ``chats(request_id, persona_id, conversation_id[, as_of])``.  Stage 1: up to
    ``recall_size`` journal entries of the persona; the rest of the window
    ``k = max(memory_window - |stage 1|, 0)`` is split into ``k // 2`` memories
    recalled with the assistant turns and ``k - k // 2`` with the user turns, each
    stage excluding the documents picked before it and the current conversation.
    Output ``(request_id, source, rank, doc_id, ..., score)``.  ``packs``: the ``open_store`` of ``store``, where several calls share it.
    """
    personas = chats.select("request_id", "persona_id", F.lit(recall_size).alias("top_n"))
    conscious = conscious_sample(store, personas, seed, time_zone)
    # repeated doc ids in the sample are skipped (first one kept)
    w = Window.partitionBy("request_id", "doc_id").orderBy("rank")
    conscious = materialize(conscious.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first"))
    n_cons = conscious.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_cons"))
    k = F.greatest(F.lit(memory_window) - F.coalesce(F.col("n_cons"), F.lit(0)), F.lit(0))
    base = chats.join(n_cons, "request_id", "left").select(
        "request_id", F.col("conversation_id").alias("exclude_conversation_id"),
        F.floor(k / 2).cast("int").alias("a_top"), (k - F.floor(k / 2)).cast("int").alias("u_top"),
        *([F.col("as_of")] if "as_of" in chats.columns else [F.lit(as_of).cast("long").alias("as_of")]))

    def stage_requests(top_col):
        return base.select("request_id", F.lit(None).cast("string").alias("document_type"),
                           F.col(top_col).alias("top_n"), F.lit(0.7).alias("turn_decay"),
                           F.lit(0.7).alias("temporal_decay"), F.lit(True).alias("filter_metadocs"),
                           "as_of", "exclude_conversation_id")

    seen1 = conscious.select("request_id", "doc_id")
    packs = packs or open_store(store)  # both stages read the same one
    # a few rows per request that are read three times below
    a = materialize(memory_query(packs, stage_requests("a_top"), assistant_texts, assistant_vectors,
                                 exclusions=seen1, time_zone=time_zone))
    seen2 = seen1.unionByName(a.select("request_id", "doc_id")).distinct()
    u = memory_query(packs, stage_requests("u_top"), user_texts, user_vectors,
                     exclusions=seen2, time_zone=time_zone)
    cols = ["request_id", "source", "rank", "doc_id", "conversation_id", "date", "speaker", "content", "score"]
    return (conscious.withColumn("source", F.lit("conscious")).select(*cols)
            .unionByName(a.withColumn("source", F.lit("assistant")).select(*cols))
            .unionByName(u.withColumn("source", F.lit("user")).select(*cols)))
