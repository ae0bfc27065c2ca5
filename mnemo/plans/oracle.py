"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on the driver's parquet tables registered as views.  The
derived views (``turns``, chat requests) repeat the expressions of
``mnemo.plans.views`` so both engines start from identical inputs.
"""

from __future__ import annotations

TURNS = """turns AS (
  SELECT 'c' || conv_id || '-' || turn AS doc_id,
         CASE WHEN conv_id % 5 = 0 AND role = 'assistant' THEN 'journal'
              WHEN conv_id % 3 = 0 AND turn >= 4 THEN 'analysis'
              WHEN conv_id % 7 = 0 AND turn = 3 THEN 'ner-task'
              WHEN conv_id % 4 = 0 AND turn = 5 THEN 'step'
              ELSE 'conversation' END AS document_type,
         'user' || (conv_id % 10) AS user_id,
         'persona' || (conv_id % 3) AS persona_id,
         'conv-' || conv_id AS conversation_id,
         CAST(CASE WHEN conv_id % 2 = 1 AND turn >= 4 THEN 1 ELSE 0 END AS INTEGER) AS branch,
         CAST(CASE WHEN conv_id % 2 = 1 AND turn >= 4 THEN turn - 2 ELSE turn END AS INTEGER) AS sequence_no,
         'all' AS listener_id,
         'conv-' || conv_id AS reference_id,
         role,
         text AS content,
         1.0::DOUBLE + CAST(conv_id % 4 AS DOUBLE) * 0.1::DOUBLE AS weight,
         CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT) AS timestamp,
         'default' AS inference_model,
         0 AS status,
         conv_id, turn,
         (conv_id * 8 + turn) % (SELECT count(*) FROM embeddings) AS vec_id
  FROM conversations)"""

TURN_VECTORS = """tv AS (
  SELECT t.*, e.embedding AS index FROM turns t LEFT JOIN embeddings e ON e.vec_id = t.vec_id)"""

def mean_vector_sql(texts: str, name: str, store: str = "tv") -> str:
    """CTE ``name(request_id, qvec)``: the mean vector of a request's ``texts(request_id, source_doc_id)``."""
    return f"""{name} AS (SELECT request_id, list(x ORDER BY i) AS qvec FROM (
  SELECT request_id, i, avg(x) AS x FROM (
    SELECT q.request_id, unnest(range(1, len(t.index) + 1)) AS i, unnest(t.index)::DOUBLE AS x
    FROM {texts} q JOIN {store} t ON t.doc_id = q.source_doc_id) GROUP BY 1, 2) GROUP BY 1)"""


CHAT_TEXTS = """qt AS (
  SELECT conversation_id AS request_id,
         CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC, doc_id DESC) - 1 AS INTEGER) AS n,
         content AS text, doc_id AS source_doc_id
  FROM turns WHERE role = 'user')"""

DATE = "strftime(make_timestamp({ts} * 1000000), '%Y-%m-%d %H:%M:%S')"
SPEAKER = "CASE WHEN {p}role = 'user' THEN {p}user_id ELSE {p}persona_id END"
COLS9 = "doc_id, document_type, user_id, persona_id, conversation_id, role, content, branch, sequence_no"
TOKENS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def memory_ctes(p: str, reqs: str, texts: str, excl: str | None = None, store: str = "tv",
                turn_decay: float = 0.7, temporal_decay: float = 0.7, as_of: int = 1709251200,
                k: int = 1000, meta: bool = True, doc_type: str | None = None) -> list[str]:
    """CTEs ending in ``{p}_out(request_id, rank, <turn columns>, distance, score)``.

    ``reqs(request_id, qvec, exclude_conversation_id, top_n)``; ``texts(request_id, n, text)``;
    ``excl(request_id, doc_id)`` optional.  Same semantics as ``operators.memory``.
    """
    tok = TOKENS.format(t="content")
    qtok = TOKENS.format(t="text")
    conds = ["s.index IS NOT NULL",
             "(r.exclude_conversation_id IS NULL OR s.conversation_id <> r.exclude_conversation_id)"]
    if meta:
        conds.append("s.document_type NOT IN ('ner-task', 'step')")
    if doc_type:
        conds.append(f"s.document_type = '{doc_type}'")
    anti = (f" AND NOT EXISTS (SELECT 1 FROM {excl} x WHERE x.request_id = r.request_id AND x.doc_id = s.doc_id)"
            if excl else "")
    return [f"""{p}_pairs AS (
  SELECT r.request_id, s.doc_id,
         list_sum(list_transform(list_zip(r.qvec, s.index), lambda q: (q[1]::DOUBLE - q[2]::DOUBLE)^2)) AS distance
  FROM {reqs} r JOIN {store} s ON {' AND '.join(conds)}{anti})""", f"""{p}_cand AS (
  SELECT request_id, doc_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, doc_id) AS rk FROM {p}_pairs)
  WHERE rk <= {k})""", f"""{p}_dterm AS (
  SELECT doc_id, term, count(*)::DOUBLE AS tf
  FROM (SELECT doc_id, unnest({tok}) AS term FROM {store} WHERE doc_id IN (SELECT doc_id FROM {p}_cand))
  GROUP BY 1, 2)""", f"""{p}_nd AS (SELECT request_id, count(*)::DOUBLE AS n_docs FROM {p}_cand GROUP BY 1)""",
            f"""{p}_ct AS (SELECT c.request_id, c.doc_id, d.term, d.tf FROM {p}_cand c JOIN {p}_dterm d USING (doc_id))""",
            f"""{p}_df AS (SELECT request_id, term, ln(any_value(nd.n_docs) / count(*)) + 1 AS idf
       FROM {p}_ct JOIN {p}_nd nd USING (request_id) GROUP BY 1, 2)""",
            f"""{p}_x AS (SELECT request_id, doc_id, term, tf * idf AS x, idf FROM {p}_ct JOIN {p}_df USING (request_id, term))""",
            f"""{p}_len AS (SELECT request_id, doc_id, sum(x) AS len FROM {p}_x GROUP BY 1, 2)""",
            f"""{p}_avgl AS (SELECT request_id, sum(x) / any_value(nd.n_docs) AS avgdl
       FROM {p}_x JOIN {p}_nd nd USING (request_id) GROUP BY 1)""",
            f"""{p}_w AS (SELECT request_id, doc_id, term, idf,
             x * idf * 2.5 / (x * (1.5 * (0.25 + 0.75 * len / avgdl)) + 1.0) AS w
      FROM {p}_x JOIN {p}_len USING (request_id, doc_id) JOIN {p}_avgl USING (request_id))""",
            f"""{p}_dn AS (SELECT request_id, doc_id, sqrt(sum(w * w)) AS dn FROM {p}_w GROUP BY 1, 2)""",
            f"""{p}_qterm AS (SELECT request_id, n, term, count(*)::DOUBLE AS qtf
          FROM (SELECT request_id, n, unnest({qtok}) AS term FROM {texts}) GROUP BY 1, 2, 3)""",
            f"""{p}_qv AS (SELECT q.request_id, q.n, q.term, (q.qtf * d.idf * d.idf) * 2.5 / (q.qtf * d.idf * d.idf + 1.5) AS v
       FROM {p}_qterm q JOIN {p}_df d USING (request_id, term))""",
            f"""{p}_qn AS (SELECT request_id, n, sqrt(sum(v * v)) AS qn FROM {p}_qv GROUP BY 1, 2)""",
            f"""{p}_dot AS (SELECT request_id, n, doc_id, sum(v * w) AS dot FROM {p}_qv JOIN {p}_w USING (request_id, term) GROUP BY 1, 2, 3)""",
            f"""{p}_best AS (SELECT request_id, doc_id,
                max(coalesce(dot / nullif(qn * dn, 0), 0.0) * pow({turn_decay}::DOUBLE, n)) AS best_sim
         FROM {p}_dot JOIN {p}_qn USING (request_id, n) JOIN {p}_dn USING (request_id, doc_id) GROUP BY 1, 2)""",
            f"""{p}_scored AS (
  SELECT c.request_id, t.*, c.distance,
         CASE WHEN EXISTS (SELECT 1 FROM {texts} q WHERE q.request_id = c.request_id)
              THEN coalesce(b.best_sim, 0.0) ELSE 1.0 END
         * (1.0 / greatest(c.distance, 1e-9) / 2.0 + 0.5) * t.weight
         * (log2(greatest(length(t.content), 1)::DOUBLE) / 2.0 + 0.5)
         * exp(-{temporal_decay}::DOUBLE * ({as_of} - t.timestamp)::DOUBLE / 604800.0) AS score
  FROM {p}_cand c JOIN {store} t USING (doc_id) LEFT JOIN {p}_best b USING (request_id, doc_id))""",
            f"""{p}_out AS (
  SELECT * EXCLUDE (top_n) FROM (
    SELECT s.*, r.top_n, CAST(row_number() OVER (PARTITION BY s.request_id ORDER BY s.score DESC, s.doc_id) AS INTEGER) AS rank
    FROM {p}_scored s JOIN {reqs} r USING (request_id))
  WHERE top_n IS NULL OR rank <= top_n)"""]


MEMORY_OUT = (f"request_id, rank, {COLS9}, {DATE.format(ts='timestamp')} AS date, {SPEAKER.format(p='')} AS speaker, "
              "printf('%.8e', score)::DOUBLE AS score")


def memory_query_sql(top_n: int = 8) -> str:
    """Chat recall for every conversation (see ``views.chat_requests``)."""
    return with_(TURNS, TURN_VECTORS, CHAT_TEXTS, mean_vector_sql("qt", "qm"), f"""
req AS (SELECT request_id, qvec, request_id AS exclude_conversation_id, {top_n} AS top_n FROM qm)""", *memory_ctes("m", "req", "qt")) + \
        f"SELECT {MEMORY_OUT} FROM m_out"


# ---- store analytics -------------------------------------------------------
T = with_(TURNS)
TURN_COLS = ("doc_id, document_type, user_id, persona_id, conversation_id, branch, sequence_no, listener_id, "
             "reference_id, role, content, weight, timestamp, inference_model, status")
DOC_TYPES = ["analysis", "brainstorm", "chore", "conversation", "ner-task", "reflection", "journal", "report", "step"]

SCAN_TURNS = T + f"SELECT {TURN_COLS} FROM turns"
STORE_SIZE = T + "SELECT count(*) AS n_rows FROM turns"
LIST_CONVERSATIONS = T + """SELECT document_type, user_id, persona_id, conversation_id, count(*) AS messages
FROM turns GROUP BY 1, 2, 3, 4"""
TYPE_COUNTS = T + "SELECT document_type, conversation_id, count(*) AS n FROM turns GROUP BY 1, 2"
LAST_ACTIVITY = T + "SELECT conversation_id, max(timestamp) AS timestamp_max FROM turns GROUP BY 1"
CONVERSATION_REPORT = T + "SELECT conversation_id, " + ", ".join(
    f"count(*) FILTER (WHERE document_type = '{t}') AS \"{t}\"" for t in DOC_TYPES) + \
    ", max(timestamp) AS timestamp_max FROM turns GROUP BY 1"
PENDING_ANALYSIS = T + """SELECT conversation_id, max(timestamp) AS timestamp_max FROM turns GROUP BY 1
HAVING count(*) FILTER (WHERE document_type = 'conversation') > 0
   AND count(*) FILTER (WHERE document_type = 'analysis') = 0"""
NEXT_PENDING = PENDING_ANALYSIS + " ORDER BY timestamp_max, conversation_id LIMIT 1"
NEXT_BRANCH = T + """, keys AS (SELECT DISTINCT 'analysis' AS document_type, user_id, persona_id, conversation_id FROM turns),
mx AS (SELECT document_type, user_id, persona_id, conversation_id, max(branch) AS mb FROM turns GROUP BY 1, 2, 3, 4)
SELECT k.document_type, k.user_id, k.persona_id, k.conversation_id, CAST(coalesce(mx.mb + 1, 0) AS INTEGER) AS next_branch
FROM keys k LEFT JOIN mx USING (document_type, user_id, persona_id, conversation_id)"""

LATEST = """latest AS (
  SELECT * FROM (SELECT *, max(branch) OVER (PARTITION BY conversation_id, sequence_no) AS mb FROM turns)
  WHERE branch = mb)"""
HISTORY = with_(TURNS, LATEST, """hist AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, branch, sequence_no, doc_id) AS INTEGER) AS pos
  FROM latest)""")
HIST_COLS = f"pos, {COLS9}, {DATE.format(ts='timestamp')} AS date, {SPEAKER.format(p='')} AS speaker"
LATEST_BRANCH_HISTORY = with_(TURNS, LATEST) + \
    f"SELECT {COLS9}, {DATE.format(ts='timestamp')} AS date, {SPEAKER.format(p='')} AS speaker FROM latest"
CONVERSATION_HISTORY = HISTORY + f"SELECT {HIST_COLS} FROM hist"
DISPLAY_CONVERSATION = HISTORY + "SELECT conversation_id, pos, role || ': ' || content AS line FROM hist"
RESUME_POSITION = HISTORY + f""", h AS (SELECT {HIST_COLS} FROM hist)
SELECT conversation_id, CAST(arg_max(sequence_no, (date, sequence_no, branch)) + 1 AS INTEGER) AS next_sequence_no,
       CAST(arg_max(branch, (date, sequence_no, branch)) AS INTEGER) AS branch
FROM h GROUP BY 1"""
GET_WHERE = T + f"""SELECT {TURN_COLS} FROM turns WHERE document_type = 'analysis'
ORDER BY timestamp DESC, doc_id LIMIT 1000"""
FILTER_METADOCS = T + "SELECT doc_id, document_type FROM turns WHERE document_type NOT IN ('ner-task', 'step')"
NON_FINAL_STEPS = T + f"""SELECT {COLS9} FROM (
  SELECT *, max(sequence_no) OVER (PARTITION BY conversation_id, document_type, branch) AS ms
  FROM turns WHERE document_type = 'analysis') WHERE sequence_no < ms"""
RETYPE_DOCUMENTS = T + """SELECT doc_id, CASE WHEN document_type = 'analysis' AND sequence_no <
    max(CASE WHEN document_type = 'analysis' THEN sequence_no END) OVER (PARTITION BY conversation_id, document_type, branch)
  THEN 'step' ELSE document_type END AS document_type FROM turns"""
# conversations holding a step document are deleted; every conversation is renamed / copied
STEP_KEYS = "skeys AS (SELECT DISTINCT user_id, persona_id, conversation_id FROM turns WHERE document_type = 'step')"
DELETE_CONVERSATION = with_(TURNS, STEP_KEYS) + """SELECT doc_id, user_id, persona_id, conversation_id FROM turns t
WHERE NOT EXISTS (SELECT 1 FROM skeys s WHERE s.user_id = t.user_id AND s.persona_id = t.persona_id
                  AND s.conversation_id = t.conversation_id)"""
RENAME_CONVERSATION = T + """SELECT doc_id, 'archive-' || user_id AS user_id, persona_id,
  conversation_id || '-moved' AS conversation_id FROM turns"""
COPY_CONVERSATION = T + """SELECT doc_id, user_id, persona_id, conversation_id FROM turns
UNION ALL
SELECT doc_id || '-copy', user_id, 'persona-copy', conversation_id FROM turns"""
ID_COLLISION = T + """SELECT DISTINCT 'c' || (conv_id + 1) || '-' || turn AS doc_id FROM turns
EXCEPT SELECT doc_id FROM turns"""


# ---- document text operators -------------------------------------------------
PY_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
SEARCH_WORD = "the"

CHUNK_WORDS = """SELECT doc_id, CAST(i // 128 AS INTEGER) AS chunk_no,
       array_to_string(list_slice(w, i + 1, i + 128), ' ') AS chunk
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) d,
     LATERAL (SELECT unnest(generate_series(0, len(d.w) - 1, 128)) AS i)"""

SEARCH_DOCUMENTS = f"""SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, array_to_string(lines, chr(10)) AS matched
FROM (SELECT doc_id, list_transform(
        list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), '{SEARCH_WORD}')),
        lambda l: regexp_replace(l, '^{PY_WS}+|{PY_WS}+$', '', 'g')) AS lines
      FROM documents)
WHERE len(lines) > 0"""

def phrases_sql(table: str, id_col: str, text_col: str, out: str = "phr") -> str:
    """CTEs ending in ``{out}(id, phrase)``: capitalised phrases before plural expansion."""
    W = r"[\p{L}\p{N}_]"
    NW = r"[^\p{L}\p{N}_]"
    return f"""{out}_toks AS (
  SELECT {id_col} AS id, regexp_extract_all({text_col}, '({NW}*)({W}+)', 1) AS gaps,
         regexp_extract_all({text_col}, '({NW}*)({W}+)', 2) AS words
  FROM {table}),
{out}_w AS (SELECT id, i - 1 AS pos, gaps[i] AS gap, words[i] AS word
      FROM {out}_toks, LATERAL (SELECT unnest(generate_series(1, len(words))) AS i)),
{out}_t AS (SELECT id, pos, word,
             regexp_matches(word, '^[A-Z][a-z]*[A-Z][a-z]*$') AS mixed,
             regexp_matches(word, '^[A-Z][a-z]+$') AND NOT (pos = 0 OR regexp_matches(gap, '[.!?]{PY_WS}')) AS eligible
      FROM {out}_w),
{out}_e AS (SELECT id, pos, word, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM {out}_t WHERE eligible),
{out}_g AS (SELECT id, run, (row_number() OVER (PARTITION BY id, run ORDER BY pos) - 1) // 3 AS grp, pos, word FROM {out}_e),
{out} AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS phrase FROM {out}_g GROUP BY id, run, grp
        UNION SELECT id, word AS phrase FROM {out}_t WHERE mixed)"""


def plurals_sql(src: str, out: str) -> str:
    return f"""{out} AS (
  SELECT id, phrase FROM {src}
  UNION SELECT p.id, p.phrase || 's' FROM {src} p
        WHERE EXISTS (SELECT 1 FROM {src} q WHERE q.id = p.id AND q.phrase = regexp_replace(p.phrase, 's+$', ''))
  UNION SELECT p.id, regexp_replace(p.phrase, 's+$', '') FROM {src} p
        WHERE EXISTS (SELECT 1 FROM {src} q WHERE q.id = p.id AND q.phrase = p.phrase || 's'))"""


CAPITALIZED_NGRAMS = with_(phrases_sql("documents", "doc_id", "text"), plurals_sql("phr", "allp")) + \
    "SELECT id AS doc_id, phrase FROM allp"


# ---- sparse text scoring: turns corpus, benchmark items as queries -------------
_TOK = TOKENS
BM25_CORE = [TURNS, f"""dt AS (SELECT doc_id, term, count(*)::DOUBLE AS tf
       FROM (SELECT doc_id, unnest({_TOK.format(t='content')}) AS term FROM turns) GROUP BY 1, 2)""",
             "n AS (SELECT count(*)::DOUBLE AS n FROM turns)",
             "df AS (SELECT term, count(*) AS df, ln(any_value(n.n) / count(*)) + 1 AS idf FROM dt, n GROUP BY term)",
             "x AS (SELECT doc_id, term, tf * idf AS x, idf FROM dt JOIN df USING (term))",
             "len AS (SELECT t.doc_id, coalesce(sum(x.x), 0) AS len FROM turns t LEFT JOIN x USING (doc_id) GROUP BY 1)",
             "a AS (SELECT avg(len) AS avgdl FROM len)",
             """w AS (SELECT doc_id, term, x * idf * 2.5 / (x * (1.5 * (0.25 + 0.75 * len / avgdl)) + 1.0) AS w
       FROM x JOIN len USING (doc_id), a)""",
             "dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM w GROUP BY 1)"]
BM25_QUERY_SIDE = [f"""qt AS (SELECT item_id, term, count(*)::DOUBLE AS tf
       FROM (SELECT item_id, unnest({_TOK.format(t='text')}) AS term FROM benchmark) GROUP BY 1, 2)""",
                   "qv AS (SELECT item_id, term, (tf * idf * idf) * 2.5 / (tf * idf * idf + 1.5) AS v FROM qt JOIN df USING (term))",
                   "qn AS (SELECT item_id, sqrt(sum(v * v)) AS qn FROM qv GROUP BY 1)",
                   "dot AS (SELECT item_id, doc_id, sum(v * w) AS dot FROM qv JOIN w USING (term) GROUP BY 1, 2)"]
CORPUS_STATS = with_(*BM25_CORE) + "SELECT term, df, round(idf, 6) AS idf FROM df"
VECTOR_NORMS = with_(*BM25_CORE) + "SELECT doc_id, round(dn, 6) AS dn FROM dn"
VOCABULARY = with_(*BM25_CORE) + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature_index FROM df"
SPARSE_DOT = with_(*BM25_CORE, *BM25_QUERY_SIDE) + "SELECT item_id, doc_id, round(dot, 6) AS dot FROM dot"
BM25_QUERY = with_(*BM25_CORE, *BM25_QUERY_SIDE) + """SELECT item_id, doc_id,
  round(coalesce(dot / nullif(qn * dn, 0), 0.0), 6) AS sim FROM dot JOIN qn USING (item_id) JOIN dn USING (doc_id)"""


def tfidf_sql() -> str:
    from ..operators.tfidf import CLEAN_PATTERN, STOP_WORDS, TOKEN_PATTERN
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    clean = CLEAN_PATTERN.replace("'", "''")

    def stream(table, id_col, text_col, out):
        return f"""{out}_tok AS (
  SELECT {id_col} AS id, regexp_extract_all(regexp_replace({text_col}, '{clean}', '', 'g'), '{TOKEN_PATTERN}') AS toks FROM {table}),
{out}_pos AS (SELECT id, unnest(toks) AS token, unnest(generate_series(0, len(toks) - 1)) AS pos FROM {out}_tok),
{out}_rep AS (SELECT id, pos, token,
    (CASE WHEN token IN ({stop}) THEN 0 ELSE 1 END) + (CASE WHEN token IN (SELECT phrase FROM ner) THEN 4 ELSE 0 END) AS reps
  FROM {out}_pos),
{out}_s AS (SELECT id, pos, unnest(range(reps)) AS sub, token FROM {out}_rep WHERE reps > 0),
{out}_g AS (SELECT id, token AS t1,
    lead(token, 1) OVER (PARTITION BY id ORDER BY pos, sub) AS t2,
    lead(token, 2) OVER (PARTITION BY id ORDER BY pos, sub) AS t3 FROM {out}_s),
{out} AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (
    SELECT id, t1 AS term FROM {out}_g
    UNION ALL SELECT id, t1 || ' ' || t2 FROM {out}_g WHERE t2 IS NOT NULL
    UNION ALL SELECT id, t1 || ' ' || t2 || ' ' || t3 FROM {out}_g WHERE t3 IS NOT NULL) GROUP BY 1, 2)"""

    return with_(TURNS, phrases_sql("benchmark", "item_id", "text", "bphr"), plurals_sql("bphr", "ner"),
                 stream("turns", "doc_id", "content", "dterms"), stream("benchmark", "item_id", "text", "qterms"),
                 "n AS (SELECT count(*)::DOUBLE AS n FROM turns)",
                 "idf AS (SELECT term, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM dterms, n GROUP BY term)",
                 """dv AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS u
        FROM dterms JOIN idf USING (term))""",
                 """qv AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS u
        FROM qterms JOIN idf USING (term))""") + \
        """SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.u * d.u), 6) AS sim
FROM qv q JOIN dv d USING (term) GROUP BY 1, 2"""


TOKEN_F1 = with_(TURNS, f"""p AS (
  SELECT a.conversation_id, a.doc_id AS query_doc_id, b.doc_id AS reply_doc_id,
         list_distinct({_TOK.format(t='a.content')}) AS qa, list_distinct({_TOK.format(t='b.content')}) AS rb
  FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')""", """s AS (
  SELECT *, len(list_intersect(qa, rb))::DOUBLE AS tp FROM p)""", """m AS (
  SELECT *, CASE WHEN len(rb) = 0 THEN 0.0 ELSE tp / len(rb) END AS prec,
            CASE WHEN len(qa) = 0 THEN 0.0 ELSE tp / len(qa) END AS rec FROM s)""") + \
    """SELECT conversation_id, query_doc_id, reply_doc_id,
  round(CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END, 6) AS f1 FROM m"""

TOTAL_STEPS_RE = (r"(?i)(?:Total[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+Steps?|Steps?[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+Total)"
                  r":[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]*(\d+)")
TOTAL_STEPS = T + r"""SELECT doc_id,
  TRY_CAST(nullif(regexp_extract(content, '(?i)(?:Total[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+Steps?|Steps?[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+Total):[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]*(\d+)', 1), '') AS INTEGER) AS total_steps
FROM turns"""


# ---- ordered turn operators ------------------------------------------------------
FOLD_TEXT = "[recalled memories]\n\n"
INSERT_AT_FOLD = HISTORY + """, f AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS users,
         count(*) OVER (PARTITION BY conversation_id) AS n
  FROM hist), g AS (
  SELECT *, min(CASE WHEN role = 'user' AND users = 4 THEN pos - 1 END) OVER (PARTITION BY conversation_id) AS fold FROM f)
SELECT conversation_id, pos, role,
  CASE WHEN pos - 1 = least(coalesce(fold, n - 1), n - 1) THEN '""" + FOLD_TEXT.replace("\n", "' || chr(10) || '") + \
    """' || content ELSE content END AS content
FROM g"""
SPLIT_BY_ROLE = HISTORY + """SELECT conversation_id, role,
  CAST(row_number() OVER (PARTITION BY conversation_id, role ORDER BY pos DESC) - 1 AS INTEGER) AS n, content FROM hist"""
UNDO_LAST_PAIR = HISTORY + """SELECT conversation_id, pos, role, content FROM (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pos DESC) AS rk,
         count(*) OVER (PARTITION BY conversation_id) AS n FROM hist) WHERE n < 2 OR rk > 2"""
NUMBER_TURNS = """with e as (select user_id session, ts, event_id, case event_type when 'view' then 'user' when 'click' then 'assistant'
             when 'error' then 'back' when 'purchase' then 'retry' else 'new' end action from events),
g as (select *, sum(case when action='new' then 1 else 0 end) over (partition by session order by ts,event_id rows unbounded preceding) seg,
             case action when 'assistant' then 1 when 'back' then -1 when 'retry' then -1 else 0 end step from e),
s as (select *, sum(step) over (partition by session,seg order by ts,event_id rows unbounded preceding) S from g),
h as (select *, S - least(0, min(S) over (partition by session,seg order by ts,event_id rows unbounded preceding)) h from s),
b as (select *, coalesce(lag(h) over (partition by session,seg order by ts,event_id),0) hb from h)
select session, event_id, sequence_no, branch from (
  select session, event_id, action,
         2*(sum(case when action='assistant' then 1 else 0 end) over w)-2 sequence_no,
         sum(case when action='back' or (action='retry' and hb>=1) then 1 else 0 end) over w branch
  from b window w as (partition by session,seg order by ts,event_id rows unbounded preceding)) z
where action='assistant'"""


# ---- recall: conscious sample, recall bundle, dense candidates --------------------
UNIFORM = "(('0x' || substr(md5({key} || ':0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
UNIFORM_KEY = "(('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def role_texts_sql(role: str, name: str) -> str:
    return f"""{name} AS (
  SELECT conversation_id AS request_id,
         CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC, doc_id DESC) - 1 AS INTEGER) AS n,
         content AS text, doc_id AS source_doc_id
  FROM turns WHERE role = '{role}')"""


CONSCIOUS = f"""cons AS (
  SELECT * FROM (
    SELECT c.request_id, t.*, {UNIFORM.format(key='t.doc_id')} * t.weight AS score,
           CAST(row_number() OVER (PARTITION BY c.request_id ORDER BY {UNIFORM.format(key='t.doc_id')} * t.weight DESC, t.doc_id)
                AS INTEGER) AS rank
    FROM (SELECT DISTINCT conversation_id AS request_id, persona_id FROM turns) c
    JOIN turns t ON t.persona_id = c.persona_id AND t.document_type = 'journal')
  WHERE rank <= 3)"""

CONSCIOUS_SAMPLE = with_(TURNS, CONSCIOUS) + f"SELECT {MEMORY_OUT} FROM cons"

def recall_bundle_sql(chats: str, texts: list[str]) -> str:
    """The three stages for requests ``chats(request_id, persona_id, conversation_id)``; ``texts``: CTEs a_texts and u_texts."""
    return with_(
        TURNS, TURN_VECTORS, f"bchats AS ({chats})", f"""cons AS (
  SELECT * FROM (
    SELECT c.request_id, t.*, {UNIFORM.format(key='t.doc_id')} * t.weight AS score,
           CAST(row_number() OVER (PARTITION BY c.request_id ORDER BY {UNIFORM.format(key='t.doc_id')} * t.weight DESC, t.doc_id)
                AS INTEGER) AS rank
    FROM bchats c JOIN turns t ON t.persona_id = c.persona_id AND t.document_type = 'journal')
  WHERE rank <= 3)""", *texts,
        """ks AS (SELECT c.request_id, c.conversation_id, greatest(8 - coalesce(n.n_cons, 0), 0) AS k FROM bchats c
       LEFT JOIN (SELECT request_id, count(*) AS n_cons FROM cons GROUP BY 1) n USING (request_id))""",
        mean_vector_sql("a_texts", "a_mean"), mean_vector_sql("u_texts", "u_mean"),
        """ra AS (SELECT request_id, coalesce(qvec, list_transform(range(64), lambda i: 0.0)) AS qvec, conversation_id AS exclude_conversation_id, k // 2 AS top_n
       FROM ks LEFT JOIN a_mean USING (request_id))""",
        """ru AS (SELECT request_id, coalesce(qvec, list_transform(range(64), lambda i: 0.0)) AS qvec, conversation_id AS exclude_conversation_id, k - k // 2 AS top_n
       FROM ks LEFT JOIN u_mean USING (request_id))""",
        "seen1 AS (SELECT request_id, doc_id FROM cons)",
        *memory_ctes("a", "ra", "a_texts", "seen1"),
        "seen2 AS (SELECT request_id, doc_id FROM seen1 UNION SELECT request_id, doc_id FROM a_out)",
        *memory_ctes("u", "ru", "u_texts", "seen2")) + f"""
SELECT request_id, 'conscious' AS source, rank, doc_id, conversation_id, {DATE.format(ts='timestamp')} AS date,
       {SPEAKER.format(p='')} AS speaker, content, printf('%.8e', score)::DOUBLE AS score FROM cons
UNION ALL
SELECT request_id, 'assistant', rank, doc_id, conversation_id, {DATE.format(ts='timestamp')},
       {SPEAKER.format(p='')}, content, printf('%.8e', score)::DOUBLE FROM a_out
UNION ALL
SELECT request_id, 'user', rank, doc_id, conversation_id, {DATE.format(ts='timestamp')},
       {SPEAKER.format(p='')}, content, printf('%.8e', score)::DOUBLE FROM u_out"""


def turn_texts_sql(role: str, name: str) -> str:
    """Texts of ``role`` up to every user turn of the conversation, newest first."""
    return f"""{name} AS (
  SELECT u.doc_id AS request_id, CAST(row_number() OVER (PARTITION BY u.doc_id ORDER BY t.timestamp DESC, t.doc_id DESC) - 1 AS INTEGER) AS n,
         t.content AS text, t.doc_id AS source_doc_id
  FROM turns u JOIN turns t ON t.conversation_id = u.conversation_id AND t.turn <= u.turn WHERE u.role = 'user' AND t.role = '{role}')"""


RECALL_BUNDLE = recall_bundle_sql("SELECT DISTINCT conversation_id AS request_id, persona_id, conversation_id FROM turns",
                                  [role_texts_sql("assistant", "a_texts"), role_texts_sql("user", "u_texts")])
STREAM_CHAT_RECALL = recall_bundle_sql("SELECT doc_id AS request_id, persona_id, conversation_id FROM turns WHERE role = 'user'",
                                       [turn_texts_sql("assistant", "a_texts"), turn_texts_sql("user", "u_texts")])

DENSE_CANDIDATES = with_(TURNS, TURN_VECTORS, CHAT_TEXTS, mean_vector_sql("qt", "qm"), """req AS (
  SELECT request_id, qvec, request_id AS exclude_conversation_id, NULL AS top_n FROM qm)""", *memory_ctes("d", "req", "qt")[:2]) + \
    "SELECT request_id, doc_id, round(distance, 6) AS distance FROM d_cand"


# ---- sources / sinks ------------------------------------------------------------------
IMPORT_COUNTS = T + "SELECT conversation_id, count(*) AS messages FROM turns GROUP BY 1"

STREAM_RECALL = with_(TURNS, TURN_VECTORS, """ur AS (
  SELECT doc_id AS request_id, index AS qvec, conversation_id AS exclude_conversation_id, 8 AS top_n
  FROM tv WHERE role = 'user')""", """ux AS (SELECT doc_id AS request_id, 0 AS n, content AS text FROM turns WHERE role = 'user')""",
                      *memory_ctes("s", "ur", "ux")) + f"SELECT {MEMORY_OUT} FROM s_out"


# ---- context assembly and pipelines (pending-analysis conversations) --------------
def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"



from ..operators.prompts import CONSCIOUS_PREFIX  # noqa: E402
from ..sources.personas import PROMPT_HEAD, PROMPT_PERSONA, PROMPT_TAIL, PROMPT_TALK  # noqa: E402
PENDING = """pend AS (SELECT conversation_id AS request_id FROM turns GROUP BY 1
  HAVING count(*) FILTER (WHERE document_type = 'conversation') > 0
     AND count(*) FILTER (WHERE document_type = 'analysis') = 0)"""
SEED = """seedh AS (
  SELECT * FROM (SELECT *, max(branch) OVER (PARTITION BY conversation_id, sequence_no) AS mb
                 FROM turns WHERE document_type <> 'ner-task' AND conversation_id IN (SELECT request_id FROM pend))
  WHERE branch = mb)""", """seed AS (
  SELECT conversation_id AS request_id, 1 AS step, 1 AS grp,
         CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, branch, sequence_no, doc_id) AS INTEGER) AS seq,
         doc_id, document_type, conversation_id, """ + DATE.format(ts="timestamp") + " AS date, " + \
    SPEAKER.format(p="") + """ AS speaker, role, content FROM seedh)""", """nb AS (
  SELECT p.request_id, CAST(coalesce(max(t.branch) + 1, 0) AS INTEGER) AS branch
  FROM pend p LEFT JOIN turns t ON t.conversation_id = p.request_id AND t.document_type = 'analysis'
  GROUP BY 1)"""
FMT_MEMORY = """fm AS (
  SELECT request_id, step, CASE WHEN body <> '' THEN body || chr(10) ELSE '' END AS text FROM (
    SELECT request_id, step, string_agg('- Memory from ' || date || ': ' || """ + strip_sql("speaker") + \
    " || ': ' || " + strip_sql("content") + """ || chr(10) || chr(10), '' ORDER BY date, grp, seq) AS body
    FROM seed GROUP BY 1, 2))"""
FMT_CONSCIOUS = """pcons AS (
  SELECT * FROM (
    SELECT c.request_id, t.*, """ + UNIFORM.format(key="t.doc_id") + """ * t.weight AS score,
           row_number() OVER (PARTITION BY c.request_id ORDER BY """ + UNIFORM.format(key="t.doc_id") + \
    """ * t.weight DESC, t.doc_id) AS rank
    FROM (SELECT DISTINCT conversation_id AS request_id, persona_id FROM turns
          WHERE conversation_id IN (SELECT request_id FROM pend)) c
    JOIN turns t ON t.persona_id = c.persona_id AND t.document_type = 'journal')
  WHERE rank <= 3)""", """fc AS (
  SELECT request_id, string_agg('- Personal Journal from ' || """ + DATE.format(ts="timestamp") + \
    """ || ': ' || content || chr(10) || chr(10), '' ORDER BY rank) AS text FROM pcons GROUP BY 1)"""
FMT_ALL = """fa AS (
  SELECT p.request_id, pp.persona_id || '""" + CONSCIOUS_PREFIX + """' || chr(10) || chr(10)
         || coalesce(fc.text, '') || coalesce(st.steps, '') AS text
  FROM pend p JOIN (SELECT DISTINCT conversation_id AS request_id, persona_id FROM turns) pp USING (request_id)
  LEFT JOIN fc USING (request_id)
  LEFT JOIN (SELECT request_id, string_agg(text, '' ORDER BY step DESC) AS steps FROM fm GROUP BY 1) st USING (request_id))"""

SEED_ANALYSIS = with_(TURNS, PENDING, *SEED) + """SELECT s.request_id, s.step, s.grp, s.seq, s.doc_id, s.document_type,
  s.conversation_id, s.date, s.speaker, s.role, s.content, nb.branch FROM seed s JOIN nb USING (request_id)"""
FORMAT_MEMORY = with_(TURNS, PENDING, *SEED, FMT_MEMORY) + "SELECT request_id, step, text FROM fm"
FORMAT_CONSCIOUS = with_(TURNS, PENDING, *FMT_CONSCIOUS) + "SELECT request_id, text FROM fc"
FORMAT_ALL = with_(TURNS, PENDING, *SEED, FMT_MEMORY, *FMT_CONSCIOUS, FMT_ALL) + "SELECT request_id, text FROM fa"
STEP_PROMPT = "Step 1: name the entities of the conversation."
BUILD_PROMPTS = with_(TURNS, PENDING, *SEED, FMT_MEMORY, *FMT_CONSCIOUS, FMT_ALL) + f"""
SELECT request_id, 0 AS msg_pos, 'user' AS role, text AS content FROM fa
UNION ALL
SELECT request_id, 1, 'user', '{STEP_PROMPT}' FROM pend"""
LAST_ASSISTANT = """lastreply AS (
  SELECT conversation_id AS request_id, content AS response FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC, doc_id DESC) AS rk
    FROM turns WHERE role = 'assistant') WHERE rk = 1)"""
# the engine's own embedding of the stored turns: token counts by md5 bucket, normalised
HASHED = """hb AS (SELECT *, list_transform(""" + TOKENS.format(t="content") + """, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64) AS bs FROM turns)""", \
    """hc AS (SELECT *, list_transform(range(64), lambda i: len(list_filter(bs, lambda b: b = i))::DOUBLE) AS cs FROM hb)""", \
    """hv AS (SELECT * EXCLUDE (bs, cs), list_transform(cs, lambda c: CASE WHEN len(bs) > 0 THEN c / sqrt(list_sum(list_transform(cs, lambda x: x * x)))
  ELSE 0.0 END::FLOAT) AS index FROM hc)"""
INSERT_THEN_RECALL = with_(TURNS, CHAT_TEXTS, *HASHED, mean_vector_sql("qt", "qm", "hv"), """req AS (
  SELECT request_id, qvec, request_id AS exclude_conversation_id, 8 AS top_n FROM qm)""", *memory_ctes("m", "req", "qt", store="hv")) + \
    f"SELECT {MEMORY_OUT} FROM m_out"
IMPORT_TWICE = T + """SELECT conversation_id, 2 * count(*) AS messages, 2 * count(*) AS ids FROM turns GROUP BY 1"""
ACCEPT_RESPONSE = with_(TURNS, PENDING, *SEED[2:], LAST_ASSISTANT) + f"""
SELECT p.request_id || '-ner-task-' || nb.branch || '-1' AS doc_id, 'ner-task' AS document_type,
       pp.persona_id AS user_id, pp.persona_id AS persona_id, p.request_id AS conversation_id,
       nb.branch AS branch, 1 AS sequence_no, 'self' AS listener_id, p.request_id AS reference_id,
       'assistant' AS role, l.response AS content, 0.7::DOUBLE AS weight, CAST(1709251200 AS BIGINT) AS timestamp,
       'default' AS inference_model, 0 AS status
FROM pend p JOIN nb USING (request_id) JOIN lastreply l USING (request_id)
JOIN (SELECT DISTINCT conversation_id AS request_id, persona_id FROM turns) pp USING (request_id)"""


def expand_plan_sql() -> str:
    from ..operators.prompts import ORDINALS, TASK_SENTENCES
    ords = "[" + ", ".join(f"'{o}'" for o in ORDINALS) + "]"
    tasks = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TASK_SENTENCES) + "]"
    steps_re = TOTAL_STEPS_RE
    return with_(TURNS, LAST_ASSISTANT, f"""plans AS (
  SELECT request_id, pl AS pipeline,
         TRY_CAST(nullif(regexp_extract(response, '{steps_re}', 1), '') AS INTEGER) AS n0
  FROM lastreply, (SELECT unnest(['chore', 'report']) AS pl))""", """p2 AS (
  SELECT request_id, pipeline, CASE WHEN n0 BETWEEN 1 AND 15 THEN n0 WHEN pipeline = 'report' THEN 4 END AS n FROM plans)""",
                 """ex AS (
  SELECT request_id, pipeline, n, unnest(generate_series(1, CASE WHEN pipeline = 'chore' THEN n + 2 ELSE n + 5 END)) AS s
  FROM p2 WHERE n IS NOT NULL)""", """cfg AS (
  SELECT *, CASE WHEN pipeline = 'chore' THEN
      CASE WHEN s = 1 THEN 'first' WHEN s = n + 2 THEN 'last' ELSE 'intermediate' END
    ELSE CASE WHEN s = 1 THEN 'ner' WHEN s = 2 THEN 'analysis' WHEN s = n + 3 THEN 'draft'
              WHEN s = n + 4 THEN 'review' WHEN s = n + 5 THEN 'final' ELSE 'intermediate' END END AS kind
  FROM ex)""") + f"""
SELECT request_id, pipeline, CAST(n AS INTEGER) AS total_steps, CAST(s AS INTEGER) AS step,
  CASE WHEN pipeline = 'chore' THEN 'chore' WHEN kind = 'ner' THEN 'ner-task' WHEN kind = 'final' THEN 'report' ELSE 'step' END AS document_type,
  CASE WHEN pipeline = 'chore' THEN 1.0 WHEN kind = 'ner' THEN 0.4 WHEN kind = 'draft' THEN 0.7
       WHEN kind = 'final' THEN 1.3 ELSE 0.3 END::DOUBLE AS weight,
  CASE kind WHEN 'first' THEN 5 WHEN 'last' THEN 1 WHEN 'ner' THEN 0 WHEN 'analysis' THEN 3
       WHEN 'draft' THEN 1 WHEN 'review' THEN 1 WHEN 'final' THEN 1
       ELSE CASE WHEN pipeline = 'chore' THEN 3 ELSE 2 END END AS top_n,
  CASE kind WHEN 'first' THEN 1024 WHEN 'last' THEN 512 WHEN 'ner' THEN 256 WHEN 'analysis' THEN 1024
       WHEN 'draft' THEN 1024 WHEN 'review' THEN 384 WHEN 'final' THEN 1024 ELSE 512 END AS max_tokens,
  CASE WHEN kind IN ('first', 'ner', 'analysis', 'intermediate') THEN true ELSE false END AS use_guidance,
  CASE WHEN pipeline = 'chore' THEN true WHEN kind = 'analysis' THEN true ELSE false END AS apply_head,
  CASE WHEN kind = 'intermediate' THEN {ords}[s - CASE WHEN pipeline = 'chore' THEN 2 ELSE 3 END + 1] END AS ordinal,
  CASE WHEN kind = 'intermediate' THEN {tasks}[CAST(floor({UNIFORM_KEY.format(key="request_id || ':' || s || ':0'")} * 15) AS INTEGER) + 1] END AS task
FROM cfg"""


# ---- memory-query variants ---------------------------------------------------------
NEWEST_USER = """nu AS (SELECT * FROM qt WHERE n = 0)"""


def typed_memory_sql(doc_type: str, top_n: int, meta: bool, turn_decay: float, temporal_decay: float) -> str:
    return with_(TURNS, TURN_VECTORS, CHAT_TEXTS, NEWEST_USER, f"""vr AS (
  SELECT q.request_id, t.index AS qvec, NULL AS exclude_conversation_id, {top_n} AS top_n
  FROM nu q JOIN tv t ON t.doc_id = q.source_doc_id)""",
                 *memory_ctes("v", "vr", "nu", meta=meta, doc_type=doc_type, turn_decay=turn_decay,
                              temporal_decay=temporal_decay)) + f"SELECT {MEMORY_OUT} FROM v_out"


NER_QUERY = typed_memory_sql("ner-task", 5, False, 0.7, 0.7)
SEED_JOURNAL = typed_memory_sql("analysis", 2, True, 0.0, 0.0)

MATRIX_NAMES = ["co", "an", "br", "ch", "co_2", "ne", "re", "jo", "re_2", "st", "ti"]
MATRIX_ABBREV = with_(TURNS) + "SELECT conversation_id AS co, " + ", ".join(
    f"count(*) FILTER (WHERE document_type = '{t}') AS {a}" for t, a in zip(DOC_TYPES, MATRIX_NAMES[1:10])) + \
    ", max(timestamp) AS ti FROM turns GROUP BY 1"

# tokenizer evaluation: query = a conversation's first turn; relevant = its other turns,
# non-relevant = the turns of the next conversation
TOKENIZERS_SQL = {
    "words": r"list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+'))",
    "ascii": r"list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+'))",
    "cased": r"list_distinct(regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+'))",
}
QRELS = """qrels AS (
  SELECT q.doc_id AS query_id, d.doc_id, CASE WHEN d.conv_id = q.conv_id THEN 'should' ELSE 'shouldnt' END AS label,
         q.content AS qtext, d.content AS dtext
  FROM turns q JOIN turns d ON (d.conv_id = q.conv_id AND d.turn <> 0) OR d.conv_id = q.conv_id + 1
  WHERE q.turn = 0)"""
QRELS_JOIN = with_(TURNS, QRELS) + "SELECT query_id, doc_id, label FROM qrels"


def _f1_sql(a: str, b: str) -> str:
    tp = f"len(list_intersect({a}, {b}))::DOUBLE"
    p = f"(CASE WHEN len({b}) = 0 THEN 0.0 ELSE {tp} / len({b}) END)"
    r = f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE {tp} / len({a}) END)"
    return f"(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END)"


TOKEN_OVERLAP_EVAL = with_(TURNS, QRELS, "scored AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS tokenizer, query_id, label, {_f1_sql(tok.format(t='qtext'), tok.format(t='dtext'))} AS f1 "
    f"FROM qrels" for name, tok in TOKENIZERS_SQL.items()) + ")", """per AS (
  SELECT tokenizer, query_id, avg(f1) FILTER (WHERE label = 'should') AS should,
         avg(f1) FILTER (WHERE label = 'shouldnt') AS shouldnt FROM scored GROUP BY 1, 2)""") + \
    """SELECT tokenizer, round(avg(should - shouldnt), 6) AS average_combined,
       round(avg(should), 6) AS average_should, round(avg(shouldnt), 6) AS average_shouldnt
FROM per WHERE should IS NOT NULL AND shouldnt IS NOT NULL GROUP BY 1"""


ACTIVE_MEMORY = with_(TURNS, TURN_VECTORS, PENDING, *SEED, *FMT_CONSCIOUS,
                      """actx AS (
  SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY date, grp, seq) - 1 AS INTEGER) AS n,
         content AS text, doc_id AS source_doc_id FROM seed WHERE role = 'assistant')""",
                      mean_vector_sql("actx", "am_mean"),
                      """areq AS (SELECT request_id, qvec, NULL AS exclude_conversation_id, 10 AS top_n FROM am_mean)""",
                      """aseen AS (SELECT request_id, doc_id FROM seed UNION SELECT request_id, doc_id FROM pcons)""",
                      "tvf AS (SELECT * FROM tv WHERE document_type <> 'analysis')",
                      *memory_ctes("am", "areq", "actx", "aseen", store="tvf", turn_decay=0.0,
                                   temporal_decay=0.8)) + f"SELECT {MEMORY_OUT} FROM am_out"


HISTORY_WITH_QUERY = with_(TURNS, TURN_VECTORS, CHAT_TEXTS, """hq AS (
  SELECT q.request_id, t.index AS qvec FROM qt q JOIN tv t ON t.doc_id = q.source_doc_id WHERE q.n = 0)""", """hp AS (
  SELECT r.request_id, s.*, list_sum(list_transform(list_zip(r.qvec, s.index), lambda q: (q[1]::DOUBLE - q[2]::DOUBLE)^2)) AS distance
  FROM hq r JOIN tv s ON s.conversation_id = r.request_id AND s.index IS NOT NULL)""", """hn AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, doc_id) AS rk FROM hp) WHERE rk <= 100)""",
                           """hl AS (
  SELECT * FROM (SELECT *, max(branch) OVER (PARTITION BY request_id, sequence_no) AS mb FROM hn) WHERE branch = mb)""") + \
    f"""SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY timestamp, branch, sequence_no, doc_id) AS INTEGER) AS pos,
  {COLS9}, {DATE.format(ts='timestamp')} AS date, {SPEAKER.format(p='')} AS speaker FROM hl"""

SEED_CHORE = typed_memory_sql("analysis", 5, True, 0.7, 0.7)

SYSTEM_PROMPTS = f"""SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_nationkey END AS user_id,
  c_name || '{PROMPT_HEAD}Room ' || c_nationkey || '{PROMPT_PERSONA}' || '#define ' || c_name || ' [seg=' || c_mktsegment || ' age=' || c_custkey || ']' || chr(10)
  || '#define Voice [' || lower(c_mktsegment) || ']#define Current Time [2024-03-01 00:00:00 (1709251200)]' || chr(10) || '#define Mood [calm]' || chr(10) || chr(10) || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN replace('{PROMPT_TALK.replace("'", "''")}', '{{0}}', 'user' || c_nationkey) ELSE '' END || '{PROMPT_TAIL}' AS system
FROM customer"""

SEED_REPORT = with_(TURNS, *HASHED, """jobs AS (
  SELECT b.item_id::VARCHAR AS request_id, b.text AS ask, d.text AS body FROM benchmark b JOIN documents d ON d.doc_id = b.item_id
  WHERE b.text IS NOT NULL AND d.text IS NOT NULL)""", """words AS (SELECT *, string_split(body, ' ') AS ws FROM jobs)""", """asked AS (
  SELECT request_id, list_concat([ask], list_transform(range(0, len(ws), 128), lambda i: array_to_string(ws[i + 1:i + 128], ' '))) AS texts FROM words)""", """st AS (
  SELECT request_id, CAST(unnest(range(len(texts))) AS INTEGER) AS n, unnest(texts) AS text FROM asked)""", """qb AS (
  SELECT j.request_id, list_transform(""" + TOKENS.format(t="ask || ' ' || body") + """, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64) AS bs FROM jobs j)""", """qc AS (
  SELECT request_id, list_transform(range(64), lambda i: len(list_filter(bs, lambda b: b = i))::DOUBLE) AS cs FROM qb)""", """req AS (
  SELECT request_id, list_transform(cs, lambda c: (CASE WHEN list_sum(cs) > 0 THEN c / sqrt(list_sum(list_transform(cs, lambda x: x * x))) ELSE 0.0 END)::FLOAT) AS qvec,
    NULL AS exclude_conversation_id, CASE WHEN len(texts) < 3 THEN 3 ELSE 2 END AS top_n FROM qc JOIN asked USING (request_id))""",
                    *memory_ctes("m", "req", "st", store="hv", doc_type="analysis")) + f"SELECT {MEMORY_OUT} FROM m_out"
