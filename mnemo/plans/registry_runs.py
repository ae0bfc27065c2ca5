"""Registered queries of the pipeline runs: rounds over all pending chats, prompts, step tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import reports as R
from ..operators import sparse as S
from ..operators import turns as TO
from ..operators.rounds import REQUEST_SCHEMA, PipelineRun, run_prefix
from ..operators.step_tables import LOCATIONS, planned_steps, render_prompts, step_rows
from ..operators.sparse_top import bm25_top, fit_transform_query
from ..operators.tfidf import tfidf_score_documents
from ..schema import CONTEXT_COLUMNS, DOC_ANALYSIS, DOC_JOURNAL, DOC_NER
from ..sources.personas import DATE_THOUGHT, THOUGHTS, system_prompts
from ..sources.term_table import TermTable
from . import oracle_runs as SQL
from .registry import _benchmark, _last_reply, _next_branches, _r6, _tz, register, scratch
from .views import AS_OF, chat_requests, chats, personas, request_vectors, session_events, step_answers, turns

ROUND_COLUMNS = ["request_id", "step", "grp", "seq", *CONTEXT_COLUMNS]


def _requests(store, asked, branch):
    """A request per conversation in ``asked(request_id)`` with what its run says."""
    profiles = system_prompts(personas(store), AS_OF, LOCATIONS["analysis"], mood="calm").select(F.col("name").alias("persona_id"), "system")
    users = store.select(F.col("conversation_id").alias("request_id"), "user_id").distinct()
    rows = (chats(store).join(asked, "request_id", "left_semi").join(users, "request_id").join(branch, "request_id").join(profiles, "persona_id")
            .withColumn("name", F.col("persona_id")))
    return rows.withColumn("guidance", F.when(F.col("persona_id") != "persona0", F.lit(SQL.GUIDANCE)))


def _analysis_run(spark, sf_dir) -> PipelineRun:
    """Analysis of all pending chats, started: seeded with each chat's history."""
    store = turns(spark, sf_dir)
    pending = R.pending_analysis(store).select(F.col("conversation_id").alias("request_id"))
    history = H.conversation_history(store, pending.select(F.col("request_id").alias("conversation_id")),
                                     filter_text=F.col("document_type") != DOC_NER, time_zone=_tz(spark))
    seed = history.withColumn("request_id", F.col("conversation_id")).withColumnRenamed("pos", "seq")
    requests = _requests(store, pending, _next_branches(store, pending, DOC_ANALYSIS))
    for c in ("query", "document"):
        requests = requests.withColumn(c, F.lit(None).cast("string"))
    requests = requests.withColumn("prefix", run_prefix("analysis", [*THOUGHTS, DATE_THOUGHT + SQL.STAMP]))
    run = PipelineRun(spark, scratch(spark, "analysis-run"), turns(spark, sf_dir, with_vectors=True), "analysis", AS_OF, time_zone=_tz(spark))
    return run.start(requests, seed)


@register("analysis_rounds", SQL.ANALYSIS_ROUNDS)
def q_analysis_rounds(spark, sf_dir):
    """Analysis of all pending chats, steps 1 to 7, the run broken off after step 3 and gone on
    with from its folder: the final context of every chat that answered all steps."""
    answers = step_answers(turns(spark, sf_dir), 7)
    run = _analysis_run(spark, sf_dir)
    run.run(answers, last=3)
    run = PipelineRun(spark, run.root, run.store, "analysis", AS_OF, time_zone=_tz(spark))
    run.run(answers)
    finished = run.turns().where("round = 7").select("request_id")
    return run.context().join(finished, "request_id", "left_semi").select(*ROUND_COLUMNS)


@register("analysis_messages", SQL.analysis_messages_sql())
def q_analysis_messages(spark, sf_dir):
    """What the model is sent at step 5: system prompt, context, the earlier turns, guidance and prompt."""
    run = _analysis_run(spark, sf_dir)
    run.run(step_answers(turns(spark, sf_dir), 7), last=4)
    run.prepare(5)
    return run.messages(5)


@register("pipeline_steps", SQL.pipeline_steps_sql())
def q_pipeline_steps(spark, sf_dir):
    """Steps of all four pipelines for every chat, with their prompts; a chat's number modulo 18 is the
    count of steps that its answer announces (0 and more than 15 are no plan)."""
    store = turns(spark, sf_dir)
    number = F.substring("request_id", len("conv-") + 1, 20).cast("long")
    newest = chat_requests(store)[1].where("n = 0").select("request_id", F.col("text").alias("query"))
    asked = chats(store).join(newest, "request_id", "left").select(
        "request_id", F.col("persona_id").alias("name"), "query", F.when(number % 2 == 1, F.concat(F.lit("notes-"), number.cast("string"), F.lit(".md"))).alias("document"))
    plans = _last_reply(store).select("request_id", F.concat(F.lit("Total Steps: "), (number % 18).cast("string"), F.lit("\n"), F.col("response")).alias("response"))
    nothing = F.lit(None).cast("string")
    fixed = asked.select("request_id").join(F.broadcast(step_rows(spark).where(F.col("pipeline").isin("analysis", "journal")))).withColumn("ordinal", nothing).withColumn("task", nothing)
    steps = fixed
    for pipeline in ("chore", "report"):
        steps = steps.unionByName(planned_steps(plans, pipeline).withColumn("pipeline", F.lit(pipeline)))
    return render_prompts(steps, asked).select("request_id", "pipeline", "step", "document_type", "weight", "top_n", "max_tokens",
                                               "use_guidance", "apply_head", "temporal_decay", "prompt")


@register("chore_context", SQL.chore_context_sql())
def q_chore_context(spark, sf_dir):
    """First round of a chore on every chat's newest user turn: the seeded analysis documents, and
    the first step's recall put before them."""
    from ..operators.memory import memory_query
    store, vectors = turns(spark, sf_dir), turns(spark, sf_dir, with_vectors=True)
    texts = chat_requests(store)[1].where("n = 0")
    found = memory_query(vectors, texts.select(
        "request_id", F.lit(DOC_ANALYSIS).alias("document_type"), F.lit(5).alias("top_n"), F.lit(0.7).alias("turn_decay"), F.lit(0.7).alias("temporal_decay"),
        F.lit(True).alias("filter_metadocs"), F.lit(AS_OF).cast("long").alias("as_of"), F.lit(None).cast("string").alias("exclude_conversation_id")),
        texts, request_vectors(vectors, texts), time_zone=_tz(spark))
    requests = _requests(store, texts.select("request_id"), texts.select("request_id", F.lit(0).alias("branch"))).join(
        texts.select("request_id", F.col("text").alias("query")), "request_id")
    requests = requests.withColumn("document", F.lit(None).cast("string")).withColumn("prefix", run_prefix("chore", []))
    run = PipelineRun(spark, scratch(spark, "chore-run"), vectors, "chore", AS_OF, time_zone=_tz(spark))
    run.start(requests.select(*[c.split()[0] for c in REQUEST_SCHEMA.split(", ")]), found.withColumnRenamed("rank", "seq"))
    run.prepare(1)
    return run.context().select(*ROUND_COLUMNS)


# ---- sparse top n, kept term counts, ordered turns ----------------------------


@register("bm25_query_top", SQL.BM25_TOP)
def q_bm25_query_top(spark, sf_dir):
    """The ten most similar turns of every benchmark item: the model is fitted and asked in one go."""
    return _r6(fit_transform_query(turns(spark, sf_dir), "doc_id", "content", _benchmark(spark, sf_dir), "item_id", "text", 10), "sim")


@register("tfidf_top", SQL.TFIDF_TOP)
def q_tfidf_top(spark, sf_dir):
    docs = turns(spark, sf_dir).select("doc_id", "content")
    return _r6(tfidf_score_documents(_benchmark(spark, sf_dir), "item_id", "text", docs, "doc_id", "content", top_n=10), "sim")


@register("term_table_query", SQL.BM25_TOP)
def q_term_table_query(spark, sf_dir):
    """The same from the counts that two appends have left in the term table; no text is read again."""
    rows, table = turns(spark, sf_dir), TermTable(spark, scratch(spark, "terms"))
    table.append(rows.where("branch = 0")).append(rows.where("branch <> 0"))
    return _r6(bm25_top(table.fit(), _benchmark(spark, sf_dir), "item_id", "text", 10), "sim")


@register("from_documents", SQL.FROM_DOCUMENTS)
def q_from_documents(spark, sf_dir):
    """A model fitted on the turns, and the turns as its vectors."""
    return _r6(S.from_documents(turns(spark, sf_dir).select("doc_id", "content"), "doc_id", "content"), "v")


@register("rewound_turns", SQL.REWOUND_TURNS)
def q_rewound_turns(spark, sf_dir):
    """Sequence numbers that go back with back and retry, and what takes a pair back."""
    return TO.rewound_turns(session_events(spark, sf_dir))


@register("split_by_role_input", SQL.SPLIT_INPUT)
def q_split_by_role_input(spark, sf_dir):
    """The texts that a chat turn asks with: the history's by role, and the new input as the newest one."""
    store = turns(spark, sf_dir)
    asked = store.select("conversation_id").distinct().withColumn("content", F.lit("What is next?"))
    return TO.split_by_role(H.conversation_history(store, time_zone=_tz(spark)), "conversation_id", "pos", asked)


@register("resume_position_all", SQL.RESUME_ALL)
def q_resume_position_all(spark, sf_dir):
    """Where each conversation's journal goes on; 0 and 0 where it has none yet."""
    store = turns(spark, sf_dir)
    journal = H.conversation_history(store, filter_text=F.col("document_type") == DOC_JOURNAL, time_zone=_tz(spark))
    return R.resume_position(journal, store.select("conversation_id"))
