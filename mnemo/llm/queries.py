"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm.ann import search
from mnemo.llm.decontaminate import DECONTAMINATE_SQL, decontaminate
from mnemo.llm.html_text import extract
from mnemo.llm.jaccard import JACCARD_SQL, jaccard_components
from mnemo.llm.langid import identify
from mnemo.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from mnemo.llm.minhash import NEAR_DUPLICATES_SQL, near_duplicates
from mnemo.llm.packing import pack
from mnemo.llm.suffix_dedup import repeated_passages
from mnemo.llm.tokens import token_counts
from mnemo.llm.toxicity import toxicity
from mnemo.llm.variants import VARIANTS_SQL, document_variants
from mnemo.llm.vector_codes import codes_sql, label_errors, vector_codes
from mnemo.sources.tables import table_path

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_decontaminate, op4_suffix_dedup, op5_html_text, op6_jaccard_join,
                                   op7_language_id, op8_toxicity, op9_nearest, op10_token_counts, op11_minhash, op12_variants, op13_vector_codes)}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op3_decontaminate": DECONTAMINATE_SQL,
    "op6_jaccard_join": JACCARD_SQL,
    "op11_minhash": NEAR_DUPLICATES_SQL,
    "op12_variants": VARIANTS_SQL,
    "op13_vector_codes": codes_sql(),
}
