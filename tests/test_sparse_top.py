"""Exact top n by bounds against all scores; counts kept beside the rows."""

import math
import random
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemo.operators import sparse as S
from mnemo.operators import sparse_top as T
from mnemo.sources.term_table import TermTable


def plain(docs, queries, n):
    """Ranked (query, doc) by the sums of products, ties by document."""
    by_doc = defaultdict(dict)
    for d, t, u in docs:
        by_doc[d][t] = u
    out = set()
    for q in {q for q, _, _ in queries}:
        scores = defaultdict(float)
        for _, t, v in (x for x in queries if x[0] == q):
            for d, ts in by_doc.items():
                if t in ts:
                    scores[d] += v * ts[t]
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))
        out |= {(q, d, k + 1) for k, (d, _) in enumerate(best[:n])}
    return out


def vectors(rng, names, terms, size):
    rows = []
    for name in names:
        # half of all vectors hold the same frequent terms
        chosen = {f"t{min(int(rng.expovariate(0.05)), terms)}" for _ in range(size)} | ({"the", "of"} if rng.random() < 0.5 else set())
        w = {t: rng.random() * (0.1 if t in ("the", "of") else 1.0) + 0.01 for t in chosen}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(name, t, x / norm) for t, x in w.items()]
    return rows


@pytest.mark.parametrize("n, head", [(1, 1), (5, 5), (5, 64), (400, 1), (None, 64)])
def test_top_by_bounds_equals_all_scores(spark, monkeypatch, n, head):
    monkeypatch.setattr(T, "HEAD_POSTINGS", head)
    rng = random.Random(n or 0)
    docs, queries = vectors(rng, [f"d{i}" for i in range(250)], 60, 12), vectors(rng, [f"q{i}" for i in range(12)], 60, 5)
    docs += [(f"e{i}", t, u) for i in range(3) for d, t, u in docs if d == "d7"]  # ties
    queries.append(("nobody", "unheard", 1.0))
    df = spark.createDataFrame(docs, "doc string, term string, u double").repartition(4)
    got = T.top_similar(df, spark.createDataFrame(queries, "q string, term string, v double"), "q", "doc", n).collect()
    assert {(r["q"], r["doc"], r["rank"]) for r in got} == plain(docs, queries, n)


def test_frequent_terms_behind_their_heads_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(T, "HEAD_POSTINGS", 4)
    asked = []
    kept = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df: asked.append(kept(df)) or asked[-1])
    docs = [(f"d{i:04}", "the", 0.05) for i in range(3_000)] + [(f"d{i:04}", "heron", 0.9) for i in range(5)]
    df = spark.createDataFrame(docs, "doc string, term string, u double")
    queries = spark.createDataFrame([("q", "the", 0.1), ("q", "heron", 0.9)], "q string, term string, v double")
    got = T.top_similar(df, queries, "q", "doc", 3).collect()
    assert [r["doc"] for r in sorted(got, key=lambda r: r["rank"])] == ["d0000", "d0001", "d0002"]
    assert asked[-1].count() <= 20  # candidates


def test_empty_sides(spark):
    docs = spark.createDataFrame([], "doc string, term string, u double")
    queries = spark.createDataFrame([("q", "a", 1.0)], "q string, term string, v double")
    assert T.top_similar(docs, queries, "q", "doc", 3).count() == 0
    assert T.top_similar(docs.unionByName(spark.createDataFrame([("d", "a", 1.0)], docs.schema)), queries.where("false"), "q", "doc", 3).count() == 0


def test_kept_counts_give_the_model_of_the_texts(spark):
    texts = [("a", "the heron and the mill"), ("b", ""), ("c", "rye rye heron"), ("d", "mill of rye"), ("e", None)]
    rows = spark.createDataFrame(texts, "doc_id string, content string")
    table = TermTable(spark, tempfile.mkdtemp(prefix="mnemo-test-"))
    table.append(rows.where("doc_id < 'c'"), batch="n1").append(rows.where("doc_id >= 'c'"), batch="n2")
    table.append(rows.where("doc_id >= 'c'"), batch="n2")  # repeated
    whole, kept = S.bm25_fit(rows, [], "doc_id", "content"), table.fit()

    def weights(model):
        return Counter((r["doc_id"], r["term"], round(r["w"], 12)) for r in model.weights.collect())

    assert weights(kept) == weights(whole) and sum(weights(whole).values()) == 9
    assert {(r["doc_id"], r["tf"]) for r in table.of_terms(["rye"]).collect()} == {("c", 2.0), ("d", 1.0)}
    plan = table.of_terms(["rye"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    queries = spark.createDataFrame([("x", "heron rye"), ("y", "unheard")], "q string, text string")
    got = T.fit_transform_query(rows, "doc_id", "content", queries, "q", "text", 1).collect()
    every = {(r["q"], r["doc_id"]): r["sim"] for r in S.bm25_query(whole, queries, ["q"], "text").collect()}
    assert [(r["q"], r["doc_id"]) for r in got] == [max(every, key=every.get)] and abs(got[0]["sim"] - max(every.values())) < 1e-12


def test_documents_as_query_vectors(spark):
    rows = spark.createDataFrame([("a", "x x y"), ("b", "y")], "doc_id string, content string")
    got = {(r["doc_id"], r["term"]): r["v"] for r in S.from_documents(rows, "doc_id", "content").collect()}
    idf = math.log(2) + 1
    assert got[("b", "y")] == pytest.approx(1 * 2.5 / 2.5) and got[("a", "x")] == pytest.approx(2 * idf ** 2 * 2.5 / (2 * idf ** 2 + 1.5))
    assert len(got) == 3


def test_model_per_key_is_refused(spark):
    with pytest.raises(ValueError):
        S.bm25_fit(spark.createDataFrame([("r", "a", "x")], "r string, doc_id string, content string"), ["r"], "doc_id", "content")


def test_tfidf_top_is_the_cut_of_all(spark):
    from mnemo.operators.tfidf import tfidf_score_documents
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(["Herons nest here.", "the Old Mill grinds rye", "rye bread", "old mill", ""])], "d string, text string")
    queries = spark.createDataFrame([("q", "Where is the Old Mill and its rye?"), ("r", "bread")], "q string, text string")
    every = tfidf_score_documents(queries, "q", "text", docs, "d", "text").collect()
    top = tfidf_score_documents(queries, "q", "text", docs, "d", "text", top_n=1).withColumn("sim", F.round("sim", 9)).collect()
    best = {q: max((round(r["sim"], 9), r["d"]) for r in every if r["q"] == q) for q in {r["q"] for r in every}}
    assert {(r["q"], (r["sim"], r["d"])) for r in top} == set(best.items())
