"""Typed schemas and fixed values of the turn store."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's behaviour) -------------------
# document types, in the reference's declaration order
DOC_ANALYSIS = "analysis"
DOC_BRAINSTORM = "brainstorm"
DOC_CHORE = "chore"
DOC_CONVERSATION = "conversation"
DOC_NER = "ner-task"
DOC_REFLECTION = "reflection"
DOC_JOURNAL = "journal"
DOC_REPORT = "report"
DOC_STEP = "step"
DOCUMENT_TYPES = [DOC_ANALYSIS, DOC_BRAINSTORM, DOC_CHORE, DOC_CONVERSATION, DOC_NER,
                  DOC_REFLECTION, DOC_JOURNAL, DOC_REPORT, DOC_STEP]
# document types hidden from recall by default
META_DOCUMENT_TYPES = [DOC_NER, DOC_STEP]

LISTENER_ALL = "all"
LISTENER_SELF = "self"
ROLE_USER = "user"
ROLE_ASSISTANT = "assistant"

# the nine columns every query result carries, in order
COLUMNS = ["doc_id", "document_type", "user_id", "persona_id", "conversation_id",
           "role", "content", "branch", "sequence_no"]
# step-context projection
CONTEXT_COLUMNS = ["doc_id", "document_type", "conversation_id", "date", "speaker", "role", "content"]

# memory-query constants
CANDIDATE_LIMIT = 1000          # nearest vectors kept per query
DEFAULT_READ_LIMIT = 1000       # generic get() bound
SECONDS_PER_WEEK = 7 * 24 * 60 * 60
BM25_K1 = 1.5
BM25_B = 0.75
MEMORY_WINDOW = 8               # memories per chat turn
RECALL_SIZE = 3                 # journal entries per chat turn
# -------------------------------------------------------------------------

TURN_FIELDS = [
    ("doc_id", T.StringType()),
    ("document_type", T.StringType()),
    ("user_id", T.StringType()),
    ("persona_id", T.StringType()),
    ("conversation_id", T.StringType()),
    ("branch", T.IntegerType()),
    ("sequence_no", T.IntegerType()),
    ("listener_id", T.StringType()),
    ("reference_id", T.StringType()),
    ("role", T.StringType()),
    ("content", T.StringType()),
    ("weight", T.DoubleType()),
    ("timestamp", T.LongType()),
    ("inference_model", T.StringType()),
    ("status", T.IntegerType()),
]
TURN_COLUMNS = [n for n, _ in TURN_FIELDS]
# export / JSONL layout: everything but the vector
TURN_NO_VECTOR = T.StructType([T.StructField(n, t, True) for n, t in TURN_FIELDS])
TURN = T.StructType(list(TURN_NO_VECTOR.fields) + [
    T.StructField("index", T.ArrayType(T.FloatType(), containsNull=False), True)])

PERSONA = T.StructType([
    T.StructField("persona_id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("default_location", T.StringType(), True),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("features", T.MapType(T.StringType(), T.StringType()), True),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("document_type", T.StringType(), True),
    T.StructField("top_n", T.IntegerType(), True),
    T.StructField("turn_decay", T.DoubleType(), True),
    T.StructField("temporal_decay", T.DoubleType(), True),
    T.StructField("filter_metadocs", T.BooleanType(), True),
    T.StructField("as_of", T.LongType(), True),
    T.StructField("exclude_conversation_id", T.StringType(), True),
])
