"""Registered queries: one per operator of the survey inventory.

Each query reads the whole given tables (through the derived views of
``mnemo.plans.views``) and returns a DataFrame whose column names match the
DuckDB oracle in ``ORACLE_SQL``.  Floating-point outputs are rounded to 6
places in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import memory_query
from ..session import session_time_zone
from . import oracle
from .views import chat_requests, request_vectors, turns

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


def _sig(df: DataFrame, *cols: str) -> DataFrame:
    """Round to 9 significant digits (scores span many orders of magnitude)."""
    for c in cols:
        df = df.withColumn(c, F.format_string("%.8e", F.col(c)).cast("double"))
    return df


@register("memory_query", oracle.memory_query_sql())
def q_memory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = turns(spark, sf_dir, with_vectors=True)
    # texts come from the vector-less view: no vector join just to read text
    requests, texts = chat_requests(turns(spark, sf_dir))
    vectors = request_vectors(store, texts)
    res = memory_query(store, requests, texts, vectors, time_zone=session_time_zone(spark))
    return _sig(res, "score")


# ---- store analytics ---------------------------------------------------------
from ..operators import history as H  # noqa: E402
from ..operators import mutations as M  # noqa: E402
from ..operators import reports as R  # noqa: E402
from ..schema import TURN_COLUMNS  # noqa: E402


def _tz(spark):
    return session_time_zone(spark)


@register("scan_turns", oracle.SCAN_TURNS)
def q_scan_turns(spark, sf_dir):
    return turns(spark, sf_dir).select(*TURN_COLUMNS)


@register("store_size", oracle.STORE_SIZE)
def q_store_size(spark, sf_dir):
    return R.store_size(turns(spark, sf_dir))


@register("list_conversations", oracle.LIST_CONVERSATIONS)
def q_list_conversations(spark, sf_dir):
    return R.list_conversations(turns(spark, sf_dir))


@register("type_counts", oracle.TYPE_COUNTS)
def q_type_counts(spark, sf_dir):
    return R.type_counts(turns(spark, sf_dir))


@register("last_activity", oracle.LAST_ACTIVITY)
def q_last_activity(spark, sf_dir):
    return R.last_activity(turns(spark, sf_dir))


@register("conversation_report", oracle.CONVERSATION_REPORT)
def q_conversation_report(spark, sf_dir):
    return R.conversation_report(turns(spark, sf_dir))


@register("pending_analysis", oracle.PENDING_ANALYSIS)
def q_pending_analysis(spark, sf_dir):
    return R.pending_analysis(turns(spark, sf_dir))


@register("next_pending", oracle.NEXT_PENDING)
def q_next_pending(spark, sf_dir):
    return R.next_pending(turns(spark, sf_dir))


@register("next_branch", oracle.NEXT_BRANCH)
def q_next_branch(spark, sf_dir):
    store = turns(spark, sf_dir)
    keys = store.select(F.lit("analysis").alias("document_type"), "user_id", "persona_id", "conversation_id").distinct()
    return R.next_branch(store, keys)


@register("latest_branch_history", oracle.LATEST_BRANCH_HISTORY)
def q_latest_branch_history(spark, sf_dir):
    return H.std_projection(H.latest_branch_history(turns(spark, sf_dir)), _tz(spark))


@register("conversation_history", oracle.CONVERSATION_HISTORY)
def q_conversation_history(spark, sf_dir):
    return H.conversation_history(turns(spark, sf_dir), time_zone=_tz(spark))


@register("display_conversation", oracle.DISPLAY_CONVERSATION)
def q_display_conversation(spark, sf_dir):
    return H.display_lines(H.conversation_history(turns(spark, sf_dir), time_zone=_tz(spark)))


@register("resume_position", oracle.RESUME_POSITION)
def q_resume_position(spark, sf_dir):
    return R.resume_position(H.conversation_history(turns(spark, sf_dir), time_zone=_tz(spark)))


@register("get_where", oracle.GET_WHERE)
def q_get_where(spark, sf_dir):
    return R.get_where(turns(spark, sf_dir), "document_type = 'analysis'", ["timestamp"]).select(*TURN_COLUMNS)


@register("filter_metadocs", oracle.FILTER_METADOCS)
def q_filter_metadocs(spark, sf_dir):
    from ..schema import META_DOCUMENT_TYPES
    return turns(spark, sf_dir).filter(~F.col("document_type").isin(*META_DOCUMENT_TYPES)).select(
        "doc_id", "document_type")


@register("non_final_steps", oracle.NON_FINAL_STEPS)
def q_non_final_steps(spark, sf_dir):
    from ..schema import COLUMNS
    return H.non_final_steps(turns(spark, sf_dir)).select(*COLUMNS)


@register("retype_documents", oracle.RETYPE_DOCUMENTS)
def q_retype_documents(spark, sf_dir):
    return H.retype_documents(turns(spark, sf_dir)).select("doc_id", "document_type")


@register("delete_conversation", oracle.DELETE_CONVERSATION)
def q_delete_conversation(spark, sf_dir):
    store = turns(spark, sf_dir)
    keys = store.filter(F.col("document_type") == "step")
    return M.delete_conversations(store, keys).select("doc_id", *M.CONV_KEYS)


def _move_all(store):
    return store.select(*M.CONV_KEYS).distinct().select(
        *M.CONV_KEYS, F.concat(F.lit("archive-"), "user_id").alias("to_user_id"),
        F.lit(None).cast("string").alias("to_persona_id"),
        F.concat("conversation_id", F.lit("-moved")).alias("to_conversation_id"))


@register("rename_conversation", oracle.RENAME_CONVERSATION)
def q_rename_conversation(spark, sf_dir):
    store = turns(spark, sf_dir)
    return M.rename_conversations(store, _move_all(store)).select("doc_id", *M.CONV_KEYS)


@register("copy_conversation", oracle.COPY_CONVERSATION)
def q_copy_conversation(spark, sf_dir):
    store = turns(spark, sf_dir)
    mapping = store.select(*M.CONV_KEYS).distinct().select(
        *M.CONV_KEYS, F.lit(None).cast("string").alias("to_user_id"), F.lit("persona-copy").alias("to_persona_id"),
        F.lit(None).cast("string").alias("to_conversation_id"))
    return M.copy_conversations(store, mapping).select("doc_id", *M.CONV_KEYS)


@register("id_collision_check", oracle.ID_COLLISION)
def q_id_collision(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    proposed = conv.select(F.concat(F.lit("c"), (F.col("conv_id") + 1).cast("string"), F.lit("-"),
                                    F.col("turn").cast("string")).alias("doc_id"))
    return M.id_collisions(turns(spark, sf_dir), proposed)


# ---- document text operators -------------------------------------------------
from ..operators import documents as D  # noqa: E402
from ..sources.tables import read_table  # noqa: E402


@register("chunk_words", oracle.CHUNK_WORDS)
def q_chunk_words(spark, sf_dir):
    return D.chunk_words(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


@register("search_documents", oracle.SEARCH_DOCUMENTS)
def q_search_documents(spark, sf_dir):
    hits = D.search_lines(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text",
                          oracle.SEARCH_WORD)
    return hits.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("matched"))


@register("capitalized_ngrams", oracle.CAPITALIZED_NGRAMS)
def q_capitalized_ngrams(spark, sf_dir):
    return D.capitalized_ngrams(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


# ---- sparse text scoring -----------------------------------------------------
from ..functions.text import tokenize, total_steps  # noqa: E402
from ..operators import sparse as S  # noqa: E402
from ..operators.tfidf import tfidf_score_documents  # noqa: E402


def _bm25_turns(spark, sf_dir):
    return S.bm25_fit(turns(spark, sf_dir).select("doc_id", "content"), [], "doc_id", "content")


def _benchmark(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark", ["item_id", "text"])


@register("corpus_stats", oracle.CORPUS_STATS)
def q_corpus_stats(spark, sf_dir):
    return _r6(S.corpus_stats(turns(spark, sf_dir).select("doc_id", "content"), "doc_id", "content"), "idf")


@register("vocabulary", oracle.VOCABULARY)
def q_vocabulary(spark, sf_dir):
    return S.vocabulary(_bm25_turns(spark, sf_dir).idf)


@register("vector_norms", oracle.VECTOR_NORMS)
def q_vector_norms(spark, sf_dir):
    return _r6(_bm25_turns(spark, sf_dir).norms, "dn")


@register("sparse_dot", oracle.SPARSE_DOT)
def q_sparse_dot(spark, sf_dir):
    return _r6(S.sparse_dot(_bm25_turns(spark, sf_dir), _benchmark(spark, sf_dir), ["item_id"], "text"), "dot")


@register("bm25_query", oracle.BM25_QUERY)
def q_bm25_query(spark, sf_dir):
    return _r6(S.bm25_query(_bm25_turns(spark, sf_dir), _benchmark(spark, sf_dir), ["item_id"], "text"), "sim")


@register("tfidf_score_documents", oracle.tfidf_sql())
def q_tfidf(spark, sf_dir):
    docs = turns(spark, sf_dir).select("doc_id", "content")
    return _r6(tfidf_score_documents(_benchmark(spark, sf_dir), "item_id", "text", docs, "doc_id", "content"), "sim")


from ..functions.embed import hashed_embedding  # noqa: E402
from ..operators.evaluation import token_f1, token_overlap_eval  # noqa: E402
from ..sources.personas import system_prompts  # noqa: E402


@register("token_f1", oracle.TOKEN_F1)
def q_token_f1(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    from .views import turns_from_conversations
    t = turns_from_conversations(conv)
    a = t.filter(F.col("role") == "user").select("conv_id", "turn", "conversation_id",
                                                 F.col("doc_id").alias("query_doc_id"), F.col("content").alias("qa"))
    b = t.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("doc_id").alias("reply_doc_id"), F.col("content").alias("rb"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conversation_id", "query_doc_id", "reply_doc_id", F.round(token_f1(tokenize("qa"), tokenize("rb")), 6).alias("f1"))


@register("total_steps", oracle.TOTAL_STEPS)
def q_total_steps(spark, sf_dir):
    return turns(spark, sf_dir).select("doc_id", total_steps("content").alias("total_steps"))


# ---- ordered turn operators ------------------------------------------------------
from ..operators import turns as TO  # noqa: E402
from .views import session_events  # noqa: E402


def _history(spark, sf_dir):
    return H.conversation_history(turns(spark, sf_dir), time_zone=_tz(spark))


@register("insert_at_fold", oracle.INSERT_AT_FOLD)
def q_insert_at_fold(spark, sf_dir):
    h = _history(spark, sf_dir).select("conversation_id", "pos", "role", "content")
    return TO.insert_at_fold(h, "conversation_id", "pos", oracle.FOLD_TEXT)


@register("split_by_role", oracle.SPLIT_BY_ROLE)
def q_split_by_role(spark, sf_dir):
    return TO.split_by_role(_history(spark, sf_dir), "conversation_id", "pos")


@register("undo_last_pair", oracle.UNDO_LAST_PAIR)
def q_undo_last_pair(spark, sf_dir):
    h = _history(spark, sf_dir).select("conversation_id", "pos", "role", "content")
    return TO.undo_last_pair(h, "conversation_id", "pos")


@register("number_turns", oracle.NUMBER_TURNS)
def q_number_turns(spark, sf_dir):
    # the blocked scan: no window is keyed by the session alone, so a hot session
    # is spread over its time blocks
    res = TO.number_turns_blocked(session_events(spark, sf_dir))
    return res.select("session", "event_id", F.col("sequence_no").cast("long"), F.col("branch").cast("long"))


# ---- recall --------------------------------------------------------------------------
from ..operators import memory as MQ  # noqa: E402
from ..operators.dense import dense_candidates, top_k_per_request  # noqa: E402
from .views import chats, role_texts  # noqa: E402


@register("conscious_sample", oracle.CONSCIOUS_SAMPLE)
def q_conscious_sample(spark, sf_dir):
    store = turns(spark, sf_dir)
    personas = chats(store).select("request_id", "persona_id", F.lit(3).alias("top_n"))
    return _sig(MQ.conscious_sample(store, personas, time_zone=_tz(spark)), "score")


@register("recall_bundle", oracle.RECALL_BUNDLE)
def q_recall_bundle(spark, sf_dir):
    store = turns(spark, sf_dir, with_vectors=True)
    base = turns(spark, sf_dir)
    at, ut = role_texts(base, "assistant"), role_texts(base, "user")
    res = MQ.recall_bundle(store, chats(base), at, request_vectors(store, at), ut, request_vectors(store, ut),
                           time_zone=_tz(spark))
    return _sig(res, "score")


@register("dense_candidates", oracle.DENSE_CANDIDATES)
def q_dense_candidates(spark, sf_dir):
    store = turns(spark, sf_dir, with_vectors=True)
    requests, texts = chat_requests(turns(spark, sf_dir))
    req = requests.join(request_vectors(store, texts), "request_id")
    cands = top_k_per_request(dense_candidates(store, req)).drop("rank")
    return _r6(cands, "distance")


# ---- sources / sinks ------------------------------------------------------------------
import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources.jsonl import export_all, import_dump  # noqa: E402
from ..sources.store import TurnStore  # noqa: E402
from .views import AS_OF  # noqa: E402


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@register("jsonl_roundtrip", oracle.SCAN_TURNS)
def q_jsonl_roundtrip(spark, sf_dir):
    """export_all -> import_dump: the imported rows."""
    path = scratch(spark, "export")
    export_all(turns(spark, sf_dir), path)
    return import_dump(spark, path, AS_OF)[0].select(*TURN_COLUMNS)


@register("import_counts", oracle.IMPORT_COUNTS)
def q_import_counts(spark, sf_dir):
    """export_all -> import_dump: the import's messages per conversation."""
    path = scratch(spark, "export")
    export_all(turns(spark, sf_dir), path)
    return import_dump(spark, path, AS_OF)[1]


@register("store_snapshot_roundtrip", oracle.SCAN_TURNS)
def q_store_snapshot(spark, sf_dir):
    """store_init -> two appends -> scan of the newest version."""
    store, rows = TurnStore(spark, scratch(spark, "store")).init(), turns(spark, sf_dir)
    store.append(rows.filter(F.col("branch") == 0), embed=None).append(rows.filter(F.col("branch") != 0), embed=None)
    return store.scan(TURN_COLUMNS)


@register("import_twice", oracle.IMPORT_TWICE)
def q_import_twice(spark, sf_dir):
    """Every conversation imported twice: all rows are kept, every one with its own id."""
    store, rows = TurnStore(spark, scratch(spark, "store")).init(), turns(spark, sf_dir)
    store.append(rows, embed=None).append(rows, embed=None)
    return store.scan().groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("doc_id").alias("ids"))


@register("insert_then_recall", oracle.INSERT_THEN_RECALL)
def q_insert_then_recall(spark, sf_dir):
    """Turns appended to an empty store, embedded on the way in, are recalled from it."""
    store = TurnStore(spark, scratch(spark, "store")).init().append(turns(spark, sf_dir)).scan()
    requests, texts = chat_requests(turns(spark, sf_dir))
    return _sig(memory_query(store, requests, texts, request_vectors(store, texts), time_zone=_tz(spark)), "score")


# ---- streaming (availableNow runs over files derived from the given tables) ----------
from ..sources.jsonl import append_jsonl  # noqa: E402
from ..streaming.ingest import start_ingest  # noqa: E402
from ..streaming.report import current_report, start_report  # noqa: E402
from ..streaming.ingest import turn_stream  # noqa: E402
from ..streaming.turns import numbered_pairs, start_numbering  # noqa: E402
from ..schema import DOCUMENT_TYPES  # noqa: E402

STREAM_SLICES = 3


def _time_slices(df, col: str, n: int):
    """``n`` consecutive event-time ranges of ``df`` (boundaries from min / max)."""
    dtype = dict(df.dtypes)[col]
    key = F.unix_micros(F.col(col).cast("timestamp")) if dtype.startswith("timestamp") else F.col(col).cast("long")
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    step = (hi - lo) // n + 1
    return [df.filter((key >= lo + i * step) & (key < lo + (i + 1) * step)) for i in range(n)]


@register("stream_ingest_dedup", oracle.SCAN_TURNS)
def q_stream_ingest(spark, sf_dir):
    """Turns that arrive newest slice first, then older ones, then all of them again (a
    repeated import), in one run each: every doc_id is stored once, none is lost."""
    src, out, ckpt = scratch(spark, "ingest-src"), scratch(spark, "ingest-out"), scratch(spark, "ingest-ckpt")
    t = turns(spark, sf_dir)
    newest, older = _time_slices(t, "timestamp", 2)[::-1]
    for part in (newest, older, t):
        append_jsonl(part, src)
        start_ingest(spark, src, out, ckpt, AS_OF, dedup=True, embed=None).awaitTermination()
    return TurnStore(spark, out).scan(TURN_COLUMNS)


@register("stream_report", oracle.CONVERSATION_REPORT)
def q_stream_report(spark, sf_dir):
    """Running report: the turns arrive in event-time slices, one availableNow run
    per slice, state carried in the checkpoint."""
    src, upd, ckpt = scratch(spark, "report-src"), scratch(spark, "report-upd"), scratch(spark, "report-ckpt")
    t = turns(spark, sf_dir)
    for part in _time_slices(t, "timestamp", STREAM_SLICES):
        append_jsonl(part, src)
        start_report(turn_stream(spark, src), upd, ckpt).awaitTermination()
    rep = current_report(spark, upd)
    return rep.select("conversation_id", *[F.col(f"`{c}`").cast("long").alias(c) for c in DOCUMENT_TYPES],
                      "timestamp_max")


@register("stream_number_turns", oracle.NUMBER_TURNS)
def q_stream_number_turns(spark, sf_dir):
    """Stateful numbering over event-time slices of the event log; sessions idle for an hour are
    evicted between them and go on from their stored state."""
    src, out, ckpt = scratch(spark, "turns-src"), scratch(spark, "turns-out"), scratch(spark, "turns-ckpt")
    ev = session_events(spark, sf_dir)
    schema = ev.schema
    for part in _time_slices(ev, "ts", STREAM_SLICES):
        part.write.mode("append").parquet(src)
        start_numbering(spark.readStream.schema(schema).parquet(src), out, ckpt, idle_seconds=3600, delay="0 seconds").awaitTermination()
    return numbered_pairs(spark, out)


@register("stream_text_recall", oracle.STREAM_RECALL)
def q_stream_text_recall(spark, sf_dir):
    """Every user turn, arriving in event-time slices, triggers a recall with its text alone against
    the store snapshot (foreachBatch -> batch memory query)."""
    from ..streaming.recall import start_recall
    src, out, ckpt = scratch(spark, "recall-src"), scratch(spark, "recall-out"), scratch(spark, "recall-ckpt")
    store = turns(spark, sf_dir, with_vectors=True)
    users = turns(spark, sf_dir).filter(F.col("role") == "user").select("doc_id", "conversation_id", "content",
                                                                       "timestamp")
    schema = users.schema
    for part in _time_slices(users, "timestamp", STREAM_SLICES):
        part.write.mode("append").parquet(src)
        start_recall(spark.readStream.schema(schema).parquet(src), store, out, ckpt, AS_OF).awaitTermination()
    res = spark.read.parquet(out).drop("batch_id")
    return _sig(res, "score")


@register("stream_recall", oracle.STREAM_CHAT_RECALL)
def q_stream_recall(spark, sf_dir):
    """The three-stage recall of every user turn.  All conversations go on side by side (a turn's event time is
    a day per turn number), so each is evicted after a slice and taken up in the next."""
    from ..streaming.chat import start_chat_recall
    src, out, ckpt = scratch(spark, "chat-src"), scratch(spark, "chat-out"), scratch(spark, "chat-ckpt")
    store = turns(spark, sf_dir, with_vectors=True)
    turn = F.split("doc_id", "-")[1].cast("long")
    rows = turns(spark, sf_dir).select("doc_id", "conversation_id", "persona_id", "role", "content",
                                       F.timestamp_seconds(F.col("timestamp") + turn * 10_000_000).alias("ts"))
    for first, last in ((0, 1), (2, 3), (4, 1 << 30)):
        rows.where(turn.between(first, last)).write.mode("append").parquet(src)
        start_chat_recall(spark.readStream.schema(rows.schema).parquet(src), store, out, ckpt, AS_OF, delay="0 seconds",
                          time_zone=_tz(spark)).awaitTermination()
    return _sig(spark.read.parquet(f"{out}/memories").drop("batch_id"), "score")


# ---- context assembly and pipelines (pending-analysis conversations) --------------
from ..operators import context as CX  # noqa: E402
from ..operators import prompts as PL  # noqa: E402
from ..schema import CONTEXT_COLUMNS  # noqa: E402


def _pending(store):
    return R.pending_analysis(store).select(F.col("conversation_id").alias("request_id"))


def _seed(spark, store):
    pend = _pending(store)
    hist = H.conversation_history(store, pend.select(F.col("request_id").alias("conversation_id")),
                                  filter_text=F.col("document_type") != "ner-task", time_zone=_tz(spark))
    rows = hist.withColumn("request_id", F.col("conversation_id"))
    return CX.accumulate(None, rows, 1, ["pos"], batch=1)


def _conscious_text(spark, store):
    pend = _pending(store)
    personas = (chats(store).join(pend, "request_id", "left_semi")
                .select("request_id", "persona_id", F.lit(3).alias("top_n")))
    return CX.format_conscious(MQ.conscious_sample(store, personas, time_zone=_tz(spark)))


def _format_all(spark, store):
    pend = _pending(store)
    prefix = chats(store).join(pend, "request_id", "left_semi").select(
        "request_id", F.concat(F.col("persona_id"), F.lit(PL.CONSCIOUS_PREFIX + "\n\n")).alias("prefix"))
    return CX.format_all(prefix, _conscious_text(spark, store), CX.format_history(_seed(spark, store)))


def _last_reply(store):
    from pyspark.sql import Window
    w = Window.partitionBy("conversation_id").orderBy(F.col("timestamp").desc(), F.col("doc_id").desc())
    return (store.filter(F.col("role") == "assistant").withColumn("_rk", F.row_number().over(w))
            .filter("_rk = 1").select(F.col("conversation_id").alias("request_id"), F.col("content").alias("response")))


def _next_branches(store, pend, document_type):
    keys = (store.join(pend.select(F.col("request_id").alias("conversation_id")), "conversation_id", "left_semi")
            .select(F.lit(document_type).alias("document_type"), "user_id", "persona_id", "conversation_id").distinct())
    return R.next_branch(store, keys).groupBy(F.col("conversation_id").alias("request_id")).agg(F.max("next_branch").alias("branch"))


@register("seed_analysis", oracle.SEED_ANALYSIS)
def q_seed_analysis(spark, sf_dir):
    store = turns(spark, sf_dir)
    nb = _next_branches(store, _pending(store), "analysis")
    return _seed(spark, store).join(nb, "request_id").select(
        "request_id", "step", "grp", "seq", *CONTEXT_COLUMNS, "branch")


@register("format_memory", oracle.FORMAT_MEMORY)
def q_format_memory(spark, sf_dir):
    return CX.format_history(_seed(spark, turns(spark, sf_dir)))


@register("format_conscious", oracle.FORMAT_CONSCIOUS)
def q_format_conscious(spark, sf_dir):
    return _conscious_text(spark, turns(spark, sf_dir))


@register("format_all", oracle.FORMAT_ALL)
def q_format_all(spark, sf_dir):
    return _format_all(spark, turns(spark, sf_dir))


@register("build_prompts", oracle.BUILD_PROMPTS)
def q_build_prompts(spark, sf_dir):
    store = turns(spark, sf_dir)
    prompts = _pending(store).select("request_id", F.lit(oracle.STEP_PROMPT).alias("prompt"))
    msgs = PL.build_messages(_format_all(spark, store), None, prompts)
    return msgs.select("request_id", F.posexplode("messages").alias("msg_pos", "m")).select(
        "request_id", "msg_pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@register("accept_response", oracle.ACCEPT_RESPONSE)
def q_accept_response(spark, sf_dir):
    store = turns(spark, sf_dir)
    pend = _pending(store)
    step1 = PL.step_table(spark).filter((F.col("pipeline") == "analysis") & (F.col("step") == 1))
    prompts = (chats(store).join(pend, "request_id", "left_semi").withColumn("pipeline", F.lit("analysis"))
               .join(F.broadcast(step1.select("pipeline", "step", "document_type", "weight")), "pipeline")
               .join(_next_branches(store, pend, "analysis"), "request_id")
               .select("request_id", "step", "document_type", "weight", F.col("persona_id").alias("user_id"),
                       "persona_id", "conversation_id", "branch", F.col("step").alias("sequence_no")))
    responses = _last_reply(store).select("request_id", F.lit(1).alias("step"), F.col("response").alias("text"))
    return M.accept_responses(prompts, responses, AS_OF)


@register("expand_plan", oracle.expand_plan_sql())
def q_expand_plan(spark, sf_dir):
    plans = _last_reply(turns(spark, sf_dir)).withColumn(
        "pipeline", F.explode(F.array(F.lit("chore"), F.lit("report"))))
    return PL.expand_plan(plans)


# ---- memory-query variants, report header projection, tokenizer evaluation ----------


def _typed_memory(spark, sf_dir, doc_type, top_n, meta, turn_decay, temporal_decay):
    store = turns(spark, sf_dir, with_vectors=True)
    requests, texts = chat_requests(turns(spark, sf_dir), top_n=top_n, turn_decay=turn_decay,
                                    temporal_decay=temporal_decay)
    newest = texts.filter(F.col("n") == 0)
    requests = requests.withColumn("document_type", F.lit(doc_type)).withColumn("filter_metadocs", F.lit(meta))
    requests = (requests.join(newest.select("request_id"), "request_id", "left_semi")
                .withColumn("exclude_conversation_id", F.lit(None).cast("string")))
    res = memory_query(store, requests, newest, request_vectors(store, newest), time_zone=_tz(spark))
    return _sig(res, "score")


@register("ner_query", oracle.NER_QUERY)
def q_ner_query(spark, sf_dir):
    """Recall restricted to ner-task documents (metadocs allowed), newest user turn as query."""
    return _typed_memory(spark, sf_dir, "ner-task", 5, False, 0.7, 0.7)


@register("seed_journal", oracle.SEED_JOURNAL)
def q_seed_journal(spark, sf_dir):
    """Journal seed: top 2 analysis documents, no turn or time decay."""
    return _typed_memory(spark, sf_dir, "analysis", 2, True, 0.0, 0.0)


@register("matrix_abbrev", oracle.MATRIX_ABBREV)
def q_matrix_abbrev(spark, sf_dir):
    rep = R.conversation_report(turns(spark, sf_dir))
    return R.abbreviate_columns(rep)


def _qrels(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    from .views import turns_from_conversations
    t = turns_from_conversations(conv)
    q = t.filter(F.col("turn") == 0).select("conv_id", F.col("doc_id").alias("query_id"), F.col("content").alias("qtext"))
    d = t.select(F.col("conv_id").alias("d_conv"), "turn", "doc_id", F.col("content").alias("dtext"))
    same = q.join(d.filter(F.col("turn") != 0), q.conv_id == d.d_conv)
    nxt = q.join(d, q.conv_id + 1 == d.d_conv)
    both = same.unionByName(nxt).dropDuplicates(["query_id", "doc_id"])
    return both.select("query_id", "doc_id", F.when(F.col("d_conv") == F.col("conv_id"), "should")
                       .otherwise("shouldnt").alias("label"), "qtext", "dtext")


@register("qrels_join", oracle.QRELS_JOIN)
def q_qrels_join(spark, sf_dir):
    return _qrels(spark, sf_dir).select("query_id", "doc_id", "label")


@register("token_overlap_eval", oracle.TOKEN_OVERLAP_EVAL)
def q_token_overlap_eval(spark, sf_dir):
    return token_overlap_eval(_qrels(spark, sf_dir))


@register("active_memory", oracle.ACTIVE_MEMORY)
def q_active_memory(spark, sf_dir):
    """Active memory of the analysis pipeline: recall with the assistant rows of the
    step context (turn decay 0, time decay 0.8), excluding everything already in
    the context or the conscious sample, analysis documents filtered out."""
    from pyspark.sql import Window
    base = turns(spark, sf_dir)
    store = turns(spark, sf_dir, with_vectors=True)
    seed = _seed(spark, base)
    w = Window.partitionBy("request_id").orderBy("date", "grp", "seq")
    texts = seed.filter(F.col("role") == "assistant").select(
        "request_id", (F.row_number().over(w) - 1).cast("int").alias("n"), F.col("content").alias("text"),
        F.col("doc_id").alias("source_doc_id"))
    pend = _pending(base)
    personas = chats(base).join(pend, "request_id", "left_semi").select("request_id", "persona_id",
                                                                         F.lit(3).alias("top_n"))
    seen = seed.select("request_id", "doc_id").unionByName(
        MQ.conscious_sample(base, personas).select("request_id", "doc_id")).distinct()
    requests = texts.filter("n = 0").select(
        "request_id", F.lit(None).cast("string").alias("document_type"), F.lit(10).alias("top_n"),
        F.lit(0.0).alias("turn_decay"), F.lit(0.8).alias("temporal_decay"), F.lit(True).alias("filter_metadocs"),
        F.lit(AS_OF).cast("long").alias("as_of"), F.lit(None).cast("string").alias("exclude_conversation_id"))
    res = memory_query(store, requests, texts, request_vectors(store, texts), exclusions=seen,
                       filter_text=F.col("document_type") != "analysis", time_zone=_tz(spark))
    return _sig(res, "score")


@register("conversation_history_query", oracle.HISTORY_WITH_QUERY)
def q_history_with_query(spark, sf_dir):
    """History of every conversation looked up with its newest user turn as the
    query: the 100 nearest rows of the conversation, newest branch, history order."""
    store = turns(spark, sf_dir, with_vectors=True)
    _requests, texts = chat_requests(turns(spark, sf_dir))
    q = request_vectors(store, texts.filter("n = 0")).withColumn("conversation_id", F.col("request_id"))
    return H.conversation_history_for_query(store, q, time_zone=_tz(spark))


@register("seed_chore", oracle.SEED_CHORE)
def q_seed_chore(spark, sf_dir):
    """Chore seed: the 5 analysis documents nearest to the task (a chat's newest user turn)."""
    return _typed_memory(spark, sf_dir, "analysis", 5, True, 0.7, 0.7)


@register("seed_report", oracle.SEED_REPORT)
def q_seed_report(spark, sf_dir):
    """Report seed: analysis documents recalled with a request text (a benchmark item) and the
    chunks of the document to report on (the one with the item's id), from a store that embeds on insert."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"))
    jobs = _benchmark(spark, sf_dir).join(docs, "item_id").where("text IS NOT NULL AND body IS NOT NULL")
    asked = (D.chunk_query_texts(jobs, "item_id", "body", "text").withColumn("request_id", F.col("item_id").cast("string")))
    requests = asked.where("n = 0").select(
        "request_id", F.lit("analysis").alias("document_type"), "top_n", F.lit(0.7).alias("turn_decay"), F.lit(0.7).alias("temporal_decay"),
        F.lit(True).alias("filter_metadocs"), F.lit(AS_OF).cast("long").alias("as_of"), F.lit(None).cast("string").alias("exclude_conversation_id"))
    texts = asked.select("request_id", F.col("n").cast("int").alias("n"), "text")
    joined = jobs.select(F.col("item_id").cast("string").alias("request_id"), hashed_embedding(F.concat_ws(" ", "text", "body")).alias("qvec"))
    store = turns(spark, sf_dir).withColumn("index", hashed_embedding("content"))
    return _sig(memory_query(store, requests, texts, joined, time_zone=_tz(spark)), "score")


@register("system_prompts", oracle.SYSTEM_PROMPTS)
def q_system_prompts(spark, sf_dir):
    """System prompt of one persona per customer, talking to nobody or to the nation's user."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    personas = c.select(
        F.col("c_name").alias("name"), F.concat(F.lit("Room "), F.col("c_nationkey").cast("string")).alias("default_location"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("age"), F.col("c_custkey").cast("string")).alias("attributes"),
        F.create_map(F.lit("Voice"), F.lower("c_mktsegment")).alias("features"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("user"), F.col("c_nationkey").cast("string"))).alias("user_id"))
    return system_prompts(personas, AS_OF, mood="calm")


from . import registry_runs  # noqa: E402, F401  (adds its queries)
