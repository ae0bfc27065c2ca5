"""DuckDB SQL of the pipeline-run queries (see ``mnemo.plans.registry_runs``)."""

from __future__ import annotations

from ..operators.prompts import CONSCIOUS_PREFIX, ORDINALS, TASK_SENTENCES
from ..operators.step_tables import (ADDIN_DOCUMENT, ADDIN_NONE, ANALYSIS_PROMPTS, CHORE_PROMPTS, GUIDANCE_THOUGHT, JOURNAL_PROMPTS, LOCATIONS,
                                     NER_FORMAT, REPORT_PROMPTS, TASK_THOUGHTS)
from ..sources.personas import DATE_THOUGHT, PROMPT_HEAD, PROMPT_PERSONA, PROMPT_TAIL, THOUGHTS
from .oracle import (BM25_CORE, BM25_QUERY_SIDE, CHAT_TEXTS, DATE, HISTORY, LAST_ASSISTANT, NUMBER_TURNS, PENDING, SEED,
                     SPEAKER, TURN_VECTORS, TURNS, UNIFORM_KEY, mean_vector_sql, memory_ctes, strip_sql, tfidf_sql, typed_memory_sql, with_)

STAMP = "2024-03-01 00:00:00"
GUIDANCE = "Keep to the point."


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def answers_sql(steps: int) -> list[str]:
    return ["""said AS (SELECT conversation_id, conv_id, content, count(*) OVER (PARTITION BY conversation_id) AS n,
  row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, doc_id) - 1 AS i FROM turns WHERE role = 'assistant')""", f"""ans AS (
  SELECT s.conversation_id AS request_id, k.step, 'Answer ' || k.step || ': ' || s.content AS text
  FROM said s JOIN (SELECT unnest(range(1, {steps + 1})) AS step) k ON (k.step - 1) % s.n = s.i
  WHERE NOT (s.conv_id % 15 = 1 AND k.step >= 2 + (s.conv_id // 15) % 5))"""]


def sample_sql(name: str, number: int, requests: str) -> str:
    score = UNIFORM_KEY.format(key=f"t.doc_id || ':{number}'") + " * t.weight"
    return f"""{name} AS (SELECT * FROM (
    SELECT c.request_id, t.*, row_number() OVER (PARTITION BY c.request_id ORDER BY {score} DESC, t.doc_id) AS rank
    FROM (SELECT DISTINCT conversation_id AS request_id, persona_id FROM turns WHERE conversation_id IN (SELECT request_id FROM {requests})) c
    JOIN turns t ON t.persona_id = c.persona_id AND t.document_type = 'journal') WHERE rank <= 3)"""


CONTEXT = "request_id, step, grp, seq, doc_id, document_type, conversation_id, date, speaker, role, content"


def recall_round_sql(number: int, top_n: int, before: str, after: str, answered: int) -> list[str]:
    """Active memory of an analysis step: context ``before`` becomes ``after`` for those that answered step ``answered``."""
    p = f"m{number}"
    return [f"al{number} AS (SELECT request_id FROM pend WHERE request_id IN (SELECT request_id FROM ans WHERE step = {answered}))",
            sample_sql(f"cons{number}", number, f"al{number}"), f"""t{number} AS (
  SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY step, date, grp, seq) - 1 AS INTEGER) AS n, content AS text, doc_id AS source_doc_id
  FROM {before} WHERE role = 'assistant' AND request_id IN (SELECT request_id FROM al{number}))""", mean_vector_sql(f"t{number}", f"qm{number}"),
            f"r{number} AS (SELECT request_id, qvec, NULL AS exclude_conversation_id, {top_n} AS top_n FROM qm{number})",
            f"seen{number} AS (SELECT request_id, doc_id FROM {before} UNION SELECT request_id, doc_id FROM cons{number})",
            *memory_ctes(p, f"r{number}", f"t{number}", f"seen{number}", store="tvf", turn_decay=0.0, temporal_decay=0.8), f"""{after} AS (
  SELECT {CONTEXT} FROM {before} WHERE request_id IN (SELECT request_id FROM al{number})
  UNION ALL SELECT request_id, {number}, 1, rank, doc_id, document_type, conversation_id, {DATE.format(ts='timestamp')}, {SPEAKER.format(p='')}, role, content FROM {p}_out)"""]


RUN = [TURNS, TURN_VECTORS, PENDING, *SEED, *answers_sql(7), "tvf AS (SELECT * FROM tv WHERE document_type <> 'analysis')", *recall_round_sql(5, 1, "seed", "c5", 4)]
ANALYSIS_ROUNDS = with_(*RUN, *recall_round_sql(7, 10, "c5", "c7", 6)) + f"SELECT {CONTEXT} FROM c7 WHERE request_id IN (SELECT request_id FROM ans WHERE step = 7)"


def prompt_sql(template: str, values: dict[str, str]) -> str:
    out = quoted(template)
    for key, value in values.items():
        if "{" + key + "}" in template:
            out = f"replace({out}, '{{{key}}}', {value})"
    return out


def _analysis_prompt(step: int) -> str:
    return prompt_sql(ANALYSIS_PROMPTS[step - 1], {"format": quoted(NER_FORMAT), "step": f"'{step}'", "name": "persona_id"})


def analysis_messages_sql(number: int = 5) -> str:
    thoughts = [TASK_THOUGHTS["analysis"], *THOUGHTS, DATE_THOUGHT + STAMP]
    who, _, rest = GUIDANCE_THOUGHT.partition("{user}")
    prefix = (f"persona_id || {quoted(CONSCIOUS_PREFIX)} || chr(10) || chr(10) || {quoted(''.join(f'- {t}' + chr(10) for t in thoughts))}"
              f" || CASE WHEN guidance IS NOT NULL THEN '- {who}' || user_id || '{rest}' || chr(10) ELSE '' END")
    system = (f"persona_id || {quoted(PROMPT_HEAD + LOCATIONS['analysis'] + PROMPT_PERSONA)} || '#define ' || persona_id || ' [age=4' || substr(persona_id, 8) || ']' || chr(10)"
              f" || '#define Voice [plain]#define Current Time [{STAMP} (1709251200)]' || chr(10) || '#define Mood [calm]' || chr(10) || chr(10) || chr(10) || {quoted(PROMPT_TAIL)}")
    turns = "".join(f"""
  UNION ALL SELECT request_id, {2 * k - 1}, 'user', 0, 0, '', 0, 0, {_analysis_prompt(k)} FROM asked
  UNION ALL SELECT a.request_id, {2 * k}, 'assistant', 0, 0, '', 0, 0, a.text FROM asked JOIN ans a USING (request_id) WHERE a.step = {k}""" for k in range(1, number))
    return with_(*RUN, f"""asked AS (
  SELECT p.request_id, t.persona_id, t.user_id, CASE WHEN t.persona_id <> 'persona0' THEN '{GUIDANCE}' END AS guidance
  FROM al{number} p JOIN (SELECT DISTINCT conversation_id AS request_id, persona_id, user_id FROM turns) t USING (request_id))""", f"""lines AS (
  SELECT request_id, -1 AS message, 'system' AS role, 0 AS part, 0 AS block, '' AS date, 0 AS grp, 0 AS seq, {system} AS text FROM asked
  UNION ALL SELECT request_id, 0, 'user', 0, 0, '', 0, 0, {prefix} FROM asked
  UNION ALL SELECT request_id, 0, 'user', 1, 0, '', 0, rank, '- Personal Journal from ' || {DATE.format(ts='timestamp')} || ': ' || content || chr(10) || chr(10) FROM cons{number}
  UNION ALL SELECT request_id, 0, 'user', 2, -2 * step, date, grp, seq, '- Memory from ' || date || ': ' || {strip_sql('speaker')} || ': ' || {strip_sql('content')} || chr(10) || chr(10) FROM c{number}
  UNION ALL SELECT DISTINCT request_id, 0, 'user', 2, -2 * step + 1, '', 0, 0, chr(10) FROM c{number}{turns}
  UNION ALL SELECT request_id, {2 * number - 1}, 'user', 0, 0, '', 0, 0, CASE WHEN guidance IS NOT NULL THEN guidance || chr(10) || chr(10) ELSE '' END || {_analysis_prompt(number)} FROM asked)""") + f"""
SELECT request_id, {number} AS step, message, role, string_agg(text, '' ORDER BY part, block, date, grp, seq) AS content, 256 AS max_tokens
FROM lines GROUP BY request_id, message, role"""


def pipeline_steps_sql() -> str:
    """Settings as written in the survey's step table, prompts from the templates."""
    values = {"format": quoted(NER_FORMAT), "step": "s::VARCHAR", "ordinal": "ordinal", "task": "task",
              "addin": f"CASE WHEN document IS NULL THEN {quoted(ADDIN_NONE)} ELSE replace({quoted(ADDIN_DOCUMENT)}, '{{document}}', document) END",
              "name": "persona_id", "query": "query"}
    rows = []
    for pipeline, prompts, settings in (
            ("analysis", ANALYSIS_PROMPTS, [("ner-task", .7, 0, 256, 1, 1), ("step", .25, 0, 256, 1, 1), ("step", .15, 0, 768, 0, 0), ("step", .5, 0, 256, 1, 0),
                                            ("step", .25, 1, 256, 1, 0), ("analysis", 1.2, 0, 512, 0, 0), ("brainstorm", .6, 10, 512, 0, 0)]),
            ("journal", JOURNAL_PROMPTS, [("step", .4, 5, 256, 1, 0), ("ner-task", .4, 3, 256, 1, 0), ("step", .4, 5, 384, 1, 0), ("step", .4, 3, 768, 1, 0),
                                          ("step", .4, 3, 384, 0, 0), ("step", .4, 3, 256, 0, 0), ("journal", 1.0, 1, 512, 0, 0), ("brainstorm", 1.0, 10, 512, 0, 0)])):
        rows += [(pipeline, str(i + 1), *s, .8, p) for i, (p, s) in enumerate(zip(prompts, settings))]
    for pipeline, prompts, settings in (
            ("chore", CHORE_PROMPTS, {"first": ("chore", 1.0, 5, 1024, 1, 1, .8), "intermediate": ("chore", 1.0, 3, 512, 1, 1, .8), "last": ("chore", 1.0, 1, 512, 0, 1, .8)}),
            ("report", REPORT_PROMPTS, {"ner": ("ner-task", .4, 0, 256, 1, 0, .8), "analysis": ("step", .3, 3, 1024, 1, 1, .5), "intermediate": ("step", .3, 2, 512, 1, 0, .8),
                                        "draft": ("step", .7, 1, 1024, 0, 0, .8), "review": ("step", .3, 1, 384, 0, 0, .8), "final": ("report", 1.3, 1, 1024, 0, 0, .8)})):
        rows += [(pipeline, kind, *settings[kind], p) for kind, p in prompts.items()]
    table = ", ".join(f"('{a}', '{k}', '{t}', {w}::DOUBLE, {n}, {m}, {bool(g)}, {bool(h)}, {d}::DOUBLE)" for a, k, t, w, n, m, g, h, d, _ in rows)
    prompt = "CASE " + " ".join(f"WHEN pipeline = '{r[0]}' AND kind = '{r[1]}' THEN {prompt_sql(r[-1], values)}" for r in rows) + " END"
    ordinals, tasks = ("[" + ", ".join(map(quoted, x)) + "]" for x in (ORDINALS, TASK_SENTENCES))
    columns = "request_id, persona_id, query, document"
    return with_(TURNS, LAST_ASSISTANT, CHAT_TEXTS, """asked AS (
  SELECT c.request_id, c.persona_id, coalesce(q.text, '') AS query, CASE WHEN c.conv_id % 2 = 1 THEN 'notes-' || c.conv_id || '.md' END AS document,
    c.conv_id % 18 AS announced, c.request_id IN (SELECT request_id FROM lastreply) AS replied
  FROM (SELECT DISTINCT conversation_id AS request_id, persona_id, conv_id FROM turns) c
  LEFT JOIN (SELECT request_id, text FROM qt WHERE n = 0) q USING (request_id))""", f"""counts AS (
  SELECT {columns}, 'analysis' AS pipeline, 7 AS last FROM asked UNION ALL SELECT {columns}, 'journal', 8 FROM asked
  UNION ALL SELECT {columns}, 'chore', announced + 2 FROM asked WHERE replied AND announced BETWEEN 1 AND 15
  UNION ALL SELECT {columns}, 'report', CASE WHEN announced BETWEEN 1 AND 15 THEN announced ELSE 4 END + 5 FROM asked WHERE replied)""", """steps AS (SELECT *, unnest(range(1, last + 1)) AS s FROM counts)""", """kinds AS (
  SELECT *, CASE pipeline WHEN 'chore' THEN CASE WHEN s = 1 THEN 'first' WHEN s = last THEN 'last' ELSE 'intermediate' END
    WHEN 'report' THEN CASE WHEN s = 1 THEN 'ner' WHEN s = 2 THEN 'analysis' WHEN s = last THEN 'final' WHEN s = last - 1 THEN 'review' WHEN s = last - 2 THEN 'draft' ELSE 'intermediate' END
    ELSE s::VARCHAR END AS kind FROM steps)""", f"""named AS (
  SELECT *, CASE WHEN kind = 'intermediate' THEN {ordinals}[s - CASE WHEN pipeline = 'chore' THEN 1 ELSE 2 END] END AS ordinal,
    CASE WHEN kind = 'intermediate' THEN {tasks}[CAST(floor({UNIFORM_KEY.format(key="request_id || ':' || s || ':0'")} * 15) AS INTEGER) + 1] END AS task FROM kinds)""", f"""settings AS (
  SELECT * FROM (VALUES {table}) v(pipeline, kind, document_type, weight, top_n, max_tokens, use_guidance, apply_head, temporal_decay))""") + f"""
SELECT request_id, pipeline, CAST(s AS INTEGER) AS step, document_type, weight, top_n, max_tokens, use_guidance, apply_head, temporal_decay, {prompt} AS prompt
FROM named JOIN settings USING (pipeline, kind)"""


#: Chore, first round: seed, then the first step's recall put before it.
def chore_context_sql() -> str:
    seed = typed_memory_sql("analysis", 5, True, 0.7, 0.7)
    assert seed.startswith("WITH ")
    body, out = seed.rsplit("SELECT request_id, rank,", 1)
    return body.rstrip() + ",\n" + ",\n".join([
        f"cseed AS (SELECT request_id, 1 AS step, 1 AS grp, rank AS seq, doc_id, document_type, conversation_id, {DATE.format(ts='timestamp')} AS date, {SPEAKER.format(p='')} AS speaker, role, content FROM v_out)",
        sample_sql("cons1", 1, "(SELECT DISTINCT request_id FROM cseed)"), """t1 AS (
  SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY date, grp, seq) - 1 AS INTEGER) AS n, content AS text, doc_id AS source_doc_id FROM cseed WHERE role = 'assistant')""",
        mean_vector_sql("t1", "qm1"), "r1 AS (SELECT request_id, qvec, NULL AS exclude_conversation_id, 5 AS top_n FROM qm1)",
        "seen1 AS (SELECT request_id, doc_id FROM cseed UNION SELECT request_id, doc_id FROM cons1)", "tvc AS (SELECT * FROM tv WHERE document_type <> 'chore')",
        *memory_ctes("c", "r1", "t1", "seen1", store="tvc", turn_decay=0.0, temporal_decay=0.8)]) + f"""
SELECT {CONTEXT} FROM cseed
UNION ALL SELECT request_id, 1, -2, rank, doc_id, document_type, conversation_id, {DATE.format(ts='timestamp')}, {SPEAKER.format(p='')}, role, content FROM c_out"""


# ---- sparse top n, kept term counts, ordered turns ----------------------------
def _cut(scores: str, n: int) -> str:
    return f"""SELECT item_id, doc_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM ({scores})) WHERE rank <= {n}"""


BM25_TOP = with_(*BM25_CORE, *BM25_QUERY_SIDE) + _cut("SELECT item_id, doc_id, dot / (qn * dn) AS sim FROM dot JOIN qn USING (item_id) JOIN dn USING (doc_id)", 10)
TFIDF_TOP = _cut(tfidf_sql().replace("round(sum(q.u * d.u), 6) AS sim", "sum(q.u * d.u) AS sim"), 10)
FROM_DOCUMENTS = with_(*BM25_CORE) + "SELECT doc_id, term, round((tf * idf * idf) * 2.5 / (tf * idf * idf + 1.5), 6) AS v FROM dt JOIN df USING (term)"
REWOUND_TURNS = NUMBER_TURNS[:NUMBER_TURNS.index("select session, event_id, sequence_no, branch from (")] + """, br as (
  select *, sum(case when action='back' or (action='retry' and hb>=1) then 1 else 0 end) over (partition by session,seg order by ts,event_id rows unbounded preceding) branch from b),
m as (select *, case when action='assistant' then hb+1 when action in ('back','retry') then hb end height from br),
l as (select *, lead(event_id) over (partition by session,seg,height order by ts,event_id) undone_by from m where height >= 1)
select session, event_id, 2*height-2 sequence_no, branch, undone_by from l where action='assistant'"""
SPLIT_INPUT = HISTORY + """, asked AS (SELECT DISTINCT conversation_id FROM turns)
SELECT conversation_id, role, CAST(row_number() OVER (PARTITION BY conversation_id, role ORDER BY pos DESC) - 1
  + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS INTEGER) AS n, content FROM hist
UNION ALL SELECT conversation_id, 'user', 0, 'What is next?' FROM asked"""
RESUME_ALL = with_(TURNS).rstrip() + """, j AS (SELECT *, max(branch) OVER (PARTITION BY conversation_id, sequence_no) AS mb FROM turns WHERE document_type = 'journal'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC, sequence_no DESC, branch DESC) AS rk FROM j WHERE branch = mb) WHERE rk = 1)
SELECT c.conversation_id, CAST(coalesce(l.sequence_no + 1, 0) AS INTEGER) AS next_sequence_no, CAST(coalesce(l.branch, 0) AS INTEGER) AS branch
FROM (SELECT DISTINCT conversation_id FROM turns) c LEFT JOIN l USING (conversation_id)"""
