"""Column-level text functions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
# word pattern of the default tokenizer: runs of Unicode letters / digits
WORD_PATTERN = r"[\p{L}\p{N}]+"
# sentence boundary used by the capitalised-phrase extractor
SENTENCE_SPLIT = r"(?<=[.!?])\s+"
# "Total Steps: n" / "Steps Total: n" marker in model output (case-insensitive)
TOTAL_STEPS_PATTERN = (r"(?i)(?:Total[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+Steps?|Steps?[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+Total)"
                       r":[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]*(\d+)")
# one whitespace character as Python's str methods define it
PY_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text, pattern: str = WORD_PATTERN) -> Column:
    """Lower-case word tokens as ARRAY<STRING> (empty array for empty / null text)."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), 0),
                      F.array().cast("array<string>"))


def char_length(text) -> Column:
    return F.char_length(_col(text))


def total_steps(text) -> Column:
    """First ``Total Steps: n`` number in a text as INT, null when absent."""
    found = F.nullif(F.regexp_extract(_col(text), TOTAL_STEPS_PATTERN, 1), F.lit(""))
    return found.try_cast("int")


def strip(text) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_col(text), f"^{PY_WS}+|{PY_WS}+$", "")


def token_ngrams(tokens, max_n: int = 3) -> Column:
    """All 1..max_n-grams of a token array, joined by single spaces: all unigrams,
    then all bigrams, ...; an empty array gives none."""
    toks = _col(tokens)
    none = F.array().cast("array<string>")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(toks) - n + 1)
        return F.when(F.size(toks) >= n, F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(none)

    return F.flatten(F.array(*[grams(n) for n in range(1, max_n + 1)]))


def query_label(n) -> Column:
    """Position -> base-26 letters as the original column suffixes: 0 -> '', 1 -> 'b', 26 -> 'ba'."""
    digits = F.lower(F.conv(_col(n).cast("string"), 10, 26))
    # conv writes base-26 digits as 0-9a-p; map them onto a-z
    mapped = F.translate(digits, "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz")
    return F.when(_col(n) == 0, F.lit("")).otherwise(mapped)


# --- fixed values: treebank tag -> wordnet part of speech (None drops the token) ---
WORDNET_POS = {
    "CC": "r", "CD": None, "DT": "r", "EX": "r", "FW": None, "IN": "r", "JJ": "a", "JJR": "a", "JJS": "a",
    "LS": None, "MD": "v", "NN": "n", "NNS": "n", "NNP": "n", "NNPS": "n", "PDT": "r", "POS": "r", "PRP": "n",
    "PRP$": "n", "RB": "r", "RBR": "r", "RBS": "r", "RP": "r", "SYM": None, "TO": "r", "UH": None, "VB": "v",
    "VBD": "v", "VBG": "v", "VBN": "v", "VBP": "v", "VBZ": "v", "WDT": "r", "WP": "n", "WP$": "n", "WRB": "r",
}
# ---------------------------------------------------------------------------------


def wordnet_pos(tagged, tag_col: str = "tag"):
    """Add ``pos`` to a ``(token, tag)`` table: unknown tags are nouns, tags that map
    to nothing drop the row (a broadcast lookup of a 36-row table)."""
    spark = tagged.sparkSession
    table = spark.createDataFrame(list(WORDNET_POS.items()), f"{tag_col} string, pos string")
    j = tagged.join(F.broadcast(table), tag_col, "left")
    known = F.col(tag_col).isin(*WORDNET_POS.keys())
    return j.filter(~known | F.col("pos").isNotNull()).withColumn("pos", F.coalesce("pos", F.lit("n")))
