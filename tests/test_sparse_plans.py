"""What the sparse scores shuffle and read, by their plans."""

import re
import tempfile

from mnemo.operators.sparse_top import top_similar
from mnemo.operators.tfidf import tfidf_score_documents
from mnemo.sources.term_table import TermTable


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_shuffled_once_per_query_term(spark):
    docs = spark.createDataFrame([(f"d{i}", t, 0.5) for i in range(40) for t in ("a", f"b{i % 3}")], "doc string, term string, u double")
    queries = spark.createDataFrame([("q", "a", 0.6), ("q", "b1", 0.8)], "q string, term string, v double")
    assert not re.search(r"hashpartitioning\((term#\d+, doc#\d+|doc#\d+, term#\d+)", plan(top_similar(docs, queries, "q", "doc", 3)))


def test_stored_counts_are_not_written_again_by_a_fit(spark):
    table = TermTable(spark, tempfile.mkdtemp(prefix="mnemo-test-"))
    rows = spark.createDataFrame([("a", "rye heron rye"), ("b", None), ("a", "rye")], "doc_id string, content string")
    table.append(rows)
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in table.terms().collect()) == [("a", "heron", 1.0), ("a", "rye", 3.0)]
    assert "FileScan parquet" in plan(table.fit().idf)


def test_only_asked_terms_leave_a_document(spark):
    docs = spark.createDataFrame([("d", "The Heron saw rye"), ("e", "old mill")], "d string, text string")
    queries = spark.createDataFrame([("q", "Where is rye?")], "q string, text string")
    assert "LeftSemi" in plan(tfidf_score_documents(queries, "q", "text", docs, "d", "text"))
