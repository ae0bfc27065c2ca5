"""Text operators over whole documents: chunking, line search, capitalised phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PY_WS, strip

# --- fixed values ----------------------------------------------------------
CHUNK_WORDS = 128
# a word of the phrase extractor (Python's Unicode \w)
WORD = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^\p{L}\p{N}_]*"
# sentence boundary: sentence punctuation followed by whitespace
SENTENCE_GAP = r"[.!?]" + PY_WS
MIXED_CASE = r"^[A-Z][a-z]*[A-Z][a-z]*$"
CAPITALIZED = r"^[A-Z][a-z]+$"
MAX_PHRASE_WORDS = 3
# ---------------------------------------------------------------------------


def chunk_words(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_WORDS) -> DataFrame:
    """``(id, chunk_no, chunk)``: the text split on single spaces (empty words
    kept) and re-joined in runs of ``size`` words.  Empty text gives one empty
    chunk.  Per-row array functions only; the explode is the single fan-out."""
    words = F.split(F.col(text_col), " ", -1)
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return docs.select(id_col, F.posexplode(chunks).alias("chunk_no", "chunk"))


def chunk_query_texts(docs: DataFrame, id_col: str, text_col: str, query_col: str,
                      size: int = CHUNK_WORDS) -> DataFrame:
    """Query list ``[query, *chunks]`` per document as ``(id, n, text)`` plus the
    recall size rule: 3 memories when the document has fewer than 2 chunks, else 2."""
    words = F.split(F.col(text_col), " ", -1)
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    texts = F.concat(F.array(F.col(query_col)), chunks)
    return docs.select(id_col, F.when(F.size(chunks) < 2, 3).otherwise(2).alias("top_n"),
                       F.posexplode(texts).alias("n", "text"))


def search_lines(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """``(id, lines)``: stripped lines containing ``query`` (case-insensitive), in
    file order; documents without a match are dropped.  One pass, no shuffle."""
    q = query.lower()
    lines = F.split(F.col(text_col), "\n", -1)
    hits = F.filter(lines, lambda line: F.lower(line).contains(q))
    return (docs.select(id_col, F.transform(hits, lambda line: strip(line)).alias("lines"))
            .filter(F.size("lines") > 0))


def capitalized_phrases(docs: DataFrame, id_col: str, text_col: str,
                        max_n: int = MAX_PHRASE_WORDS) -> DataFrame:
    """Distinct ``(id, phrase)`` before plural expansion.

    Mixed-case words (``McRib``, ``ML``) count anywhere; runs of capitalised words
    (``Deep Learning Model``) count unless sentence-initial and are cut into
    groups of ``max_n`` from the start of the run.  A word is sentence-initial when
    it is the first word, or the gap before it holds punctuation + whitespace.
    """
    pat = f"({NON_WORD})({WORD})"
    t = F.col(text_col)
    # the two arrays are materialised as columns once (a lambda must not re-run the regex)
    arrs = docs.select(id_col, F.regexp_extract_all(t, F.lit(pat), 1).alias("_gaps"),
                       F.regexp_extract_all(t, F.lit(pat), 2).alias("_words"))
    # both word patterns start with an ASCII capital: only those words (with their
    # position and preceding gap) are exploded into rows
    pairs = F.arrays_zip(F.col("_gaps").alias("gap"), F.col("_words").alias("word"),
                         F.sequence(F.lit(0), F.size("_words") - 1).alias("pos"))
    capital = F.filter(pairs, lambda x: x["word"].rlike("^[A-Z]"))
    exploded = arrs.select(id_col, F.explode(capital).alias("gw"))
    tagged = exploded.select(
        id_col, F.col("gw.pos").alias("pos"), F.col("gw.word").alias("word"),
        ((F.col("gw.pos") == 0) | F.col("gw.gap").rlike(SENTENCE_GAP)).alias("initial"))
    tagged = tagged.select(id_col, "pos", "word",
                           F.col("word").rlike(MIXED_CASE).alias("mixed"),
                           (F.col("word").rlike(CAPITALIZED) & ~F.col("initial")).alias("eligible"))
    # one flow (the text is scanned once): mixed-case words are single-word groups,
    # eligible words form runs by gaps-and-islands over positions, cut into groups
    # of max_n from the start of the run
    cand = tagged.filter(F.col("mixed") | F.col("eligible"))
    w = Window.partitionBy(id_col, "eligible").orderBy("pos")
    cand = cand.withColumn("run", F.when(F.col("eligible"), F.col("pos") - F.row_number().over(w))
                           .otherwise(F.col("pos")))
    wr = Window.partitionBy(id_col, "eligible", "run").orderBy("pos")
    cand = cand.withColumn("grp", F.when(F.col("eligible"), F.floor((F.row_number().over(wr) - 1) / max_n))
                           .otherwise(F.lit(0)))
    grouped = cand.groupBy(id_col, "eligible", "run", "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]),
                     " ").alias("phrase"))
    return grouped.select(id_col, "phrase").distinct()


def expand_plurals(phrases: DataFrame, id_col: str) -> DataFrame:
    """Add ``m + 's'`` when ``m`` without trailing s is present (a word with no
    trailing s always gains its plural), and the stripped form when ``m + 's'`` is
    present.  Conditions are read on the original set.  Works on each document's
    phrase set as an array (no self-join, so the phrase plan runs once)."""
    sets = phrases.groupBy(id_col).agg(F.collect_set("phrase").alias("_s"))
    strip_s = lambda m: F.regexp_replace(m, "s+$", "")
    plural = F.transform(F.filter("_s", lambda m: F.array_contains(F.col("_s"), strip_s(m))),
                         lambda m: F.concat(m, F.lit("s")))
    singular = F.transform(F.filter("_s", lambda m: F.array_contains(F.col("_s"), F.concat(m, F.lit("s")))),
                           strip_s)
    return sets.select(id_col, F.explode(F.array_distinct(F.concat("_s", plural, singular))).alias("phrase"))


def capitalized_ngrams(docs: DataFrame, id_col: str, text_col: str, max_n: int = MAX_PHRASE_WORDS) -> DataFrame:
    return expand_plurals(capitalized_phrases(docs, id_col, text_col, max_n), id_col)
