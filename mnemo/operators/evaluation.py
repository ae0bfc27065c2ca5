"""Token-overlap evaluation of tokenizers against judged query / document pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the compared tokenizers (regex word splitters) ----------
TOKENIZERS = {
    "words": (r"[\p{L}\p{N}]+", True),
    "ascii": (r"[a-z0-9]+", True),
    "cased": (r"[\p{L}\p{N}]+", False),
}
# ---------------------------------------------------------------------------


def token_set(text: Column, pattern: str, lower: bool) -> Column:
    t = F.lower(text) if lower else text
    return F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), 0))


def token_f1(relevant: Column, retrieved: Column) -> Column:
    """Set F1 of two token arrays; 0 when either side is empty."""
    relevant, retrieved = F.array_distinct(relevant), F.array_distinct(retrieved)
    tp = F.size(F.array_intersect(relevant, retrieved)).cast("double")
    prec = F.when(F.size(retrieved) == 0, 0.0).otherwise(tp / F.size(retrieved))
    rec = F.when(F.size(relevant) == 0, 0.0).otherwise(tp / F.size(relevant))
    return F.when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec))


def token_overlap_eval(qrels: DataFrame) -> DataFrame:
    """Leaderboard ``(tokenizer, average_combined, average_should, average_shouldnt)``.

    ``qrels(query_id, doc_id, label in {should, shouldnt}, qtext, dtext)``.  Per
    tokenizer and query: mean F1 of relevant and of non-relevant documents, their
    difference; averaged over queries.  The judged pairs are read once: every pair is
    scored by all tokenizers and the scores are exploded.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"),
                               token_f1(token_set(F.col("qtext"), pattern, lower),
                                        token_set(F.col("dtext"), pattern, lower)).alias("f1"))
                      for name, (pattern, lower) in TOKENIZERS.items()])
    scored = qrels.select("query_id", "label", F.inline(pairs))
    per = scored.groupBy("tokenizer", "query_id").agg(
        F.avg(F.when(F.col("label") == "should", F.col("f1"))).alias("should"),
        F.avg(F.when(F.col("label") == "shouldnt", F.col("f1"))).alias("shouldnt"))
    per = per.filter(F.col("should").isNotNull() & F.col("shouldnt").isNotNull())
    board = per.groupBy("tokenizer").agg(
        F.round(F.avg(F.col("should") - F.col("shouldnt")), 6).alias("average_combined"),
        F.round(F.avg("should"), 6).alias("average_should"),
        F.round(F.avg("shouldnt"), 6).alias("average_shouldnt"))
    return board.orderBy(F.col("average_combined").desc())
