"""Capitalised-phrase boosted n-gram TF-IDF cosine (queries x documents).

Preprocessing of every text: delete characters outside letters, digits,
whitespace and ``- . , ? ! : ;``; split into word tokens; drop English stop
words (case-sensitive); a token equal to a one-word capitalised phrase of any
query is repeated 4 more times right after itself (also when it is a stop word,
then only the 4 copies remain).  Terms are the 1-, 2- and 3-grams of that token
stream.  Weights: raw count x smoothed idf ``ln((1 + N) / (1 + df)) + 1`` fitted on
the documents, L2-normalised; similarity is the dot product of the normalised
vectors over shared terms (query terms unseen in the documents vanish).

Everything is long form: one row per (text, position) for the token stream,
n-grams from ``lead`` over a per-text window, sums by term.  No densified matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PY_WS
from ..session import materialize
from .documents import capitalized_ngrams
from .sparse_top import top_similar

# --- fixed values ----------------------------------------------------------
NER_BOOST = 4
NGRAM_MAX = 3
# characters removed before tokenizing (everything but letters, digits, whitespace, - . , ? ! : ;)
CLEAN_PATTERN = r"[^a-zA-Z0-9" + PY_WS[1:-1] + r"\-.,?!:;]"
TOKEN_PATTERN = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
# NLTK English stop words (179)
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't",
    "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]
# ---------------------------------------------------------------------------


# largest boost-phrase set joined by broadcast
MAX_BROADCAST_PHRASES = 1_000_000


def token_stream(texts: DataFrame, id_col: str, text_col: str, ner_terms: DataFrame | None,
                 broadcast_ner: bool = False) -> DataFrame:
    """``(id, pos, sub, token)``: the boosted token stream, ordered by (pos, sub)."""
    toks = F.regexp_extract_all(F.regexp_replace(F.col(text_col), CLEAN_PATTERN, ""), F.lit(TOKEN_PATTERN), 0)
    ex = texts.select(id_col, F.posexplode(toks).alias("pos", "token"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    if ner_terms is not None:
        look = ner_terms.select(F.col("phrase").alias("token")).distinct().withColumn("ner", F.lit(True))
        ex = ex.join(F.broadcast(look) if broadcast_ner else look, "token", "left")
    else:
        ex = ex.withColumn("ner", F.lit(None).cast("boolean"))
    reps = (F.when(F.array_contains(stop, F.col("token")), 0).otherwise(1)
            + F.when(F.col("ner"), NER_BOOST).otherwise(0))
    return ex.select(id_col, "pos", F.posexplode(F.array_repeat(F.col("token"), reps)).alias("sub", "token"))


def ngram_counts(stream: DataFrame, id_col: str, max_n: int = NGRAM_MAX) -> DataFrame:
    """``(id, term, tf)`` over all 1..max_n-grams of each text's token stream."""
    w = Window.partitionBy(id_col).orderBy("pos", "sub")
    leads = stream.select(id_col, "token", *[F.lead("token", i).over(w).alias(f"t{i}") for i in range(1, max_n)])
    grams = [F.col("token")]
    acc = F.col("token")
    for i in range(1, max_n):
        acc = F.concat_ws(" ", acc, F.col(f"t{i}"))
        grams.append(F.when(F.col(f"t{i}").isNotNull(), acc))
    ex = leads.select(id_col, F.explode(F.array(*grams)).alias("term")).filter(F.col("term").isNotNull())
    return ex.groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def tfidf_score_documents(queries: DataFrame, qid: str, qtext: str,
                          docs: DataFrame, did: str, dtext: str, top_n: int | None = None) -> DataFrame:
    """``(qid, did, sim)`` for query/document pairs sharing a term; with ``top_n`` (and ``rank``) each query's best only."""
    ner = capitalized_ngrams(queries, qid, qtext).select("phrase").distinct()
    small = ner.count() <= MAX_BROADCAST_PHRASES  # size check before broadcasting the boost set
    # idf is a grouped aggregate joined back (AQE can split a hot term), not a
    # window keyed by the term
    d_terms = ngram_counts(token_stream(docs, did, dtext, ner, small), did)
    q_terms = materialize(ngram_counts(token_stream(queries, qid, qtext, ner, small), qid))
    # a document's norm takes all its terms; behind it only terms of some query matter
    asked = q_terms.select("term").distinct()
    asked = F.broadcast(asked) if q_terms.count() <= MAX_BROADCAST_PHRASES else asked
    n_docs = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    idf = d_terms.groupBy("term").agg(
        (F.log((n_docs + 1.0) / (F.count(F.lit(1)) + 1.0)) + 1.0).alias("idf"))

    def normalised(terms, key):
        # the norm is a window over one text's terms (bounded by the text), so the
        # weighted rows are consumed by a single chain
        x = terms.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
        return x.select(key, "term", (F.col("x") / norm).alias("u"))

    if top_n is not None:
        docs_u = materialize(normalised(d_terms, did).join(asked, "term", "left_semi"))
        return top_similar(docs_u, normalised(q_terms, qid).withColumnRenamed("u", "v"), qid, did, top_n)
    dv = normalised(d_terms, did).join(asked, "term", "left_semi").withColumnRenamed("u", "du")
    qv = normalised(q_terms, qid).withColumnRenamed("u", "qu")
    return (qv.join(dv, "term").groupBy(qid, did)
            .agg(F.sum(F.col("qu") * F.col("du")).alias("sim")))
