"""Document library: a folder of text files read with the ``binaryFile`` source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
# names ending in these suffixes are library documents (suffix match, no dot)
EXTENSIONS = ["org", "txt", "md"]
# ---------------------------------------------------------------------------


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").load(root)


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(name, modificationTime, length)`` of the library files (content not read)."""
    files = _files(spark, root).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return (files.select(name.alias("name"), "modificationTime", "length")
            .filter(F.col("name").rlike("(" + "|".join(EXTENSIONS) + ")$")))


def document_exists(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """``(name, exists)`` for a table of names (semi-join style lookup, no loop)."""
    have = list_documents(spark, root).select("name").withColumn("exists", F.lit(True))
    return names.select("name").join(have, "name", "left").select(
        "name", F.coalesce(F.col("exists"), F.lit(False)).alias("exists"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(name, text)``: bytes decoded as UTF-8, invalid sequences replaced."""
    files = _files(spark, root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return (files.select(name.alias("name"), text.alias("text"))
            .filter(F.col("name").rlike("(" + "|".join(EXTENSIONS) + ")$")))


def search_library(spark: SparkSession, root: str, query: str) -> DataFrame:
    """``(name, lines)`` of stripped matching lines per file, file order kept."""
    from ..operators.documents import search_lines
    return search_lines(read_documents(spark, root), "name", "text", query)
