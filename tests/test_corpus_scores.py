"""Scores of many small corpora against a loop over terms."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators.sparse import best_corpus_scores, bm25_fit, bm25_query, corpus_scores, hashed_tokens


def plain(docs, text, k1=1.5, b=0.75):
    n = len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n / c) + 1 for t, c in df.items()}
    length = [sum(idf[t] for t in d) for d in docs]
    avg = sum(length) / n
    v = {t: c * idf[t] ** 2 * (k1 + 1) / (c * idf[t] ** 2 + k1) for t, c in Counter(text).items() if t in idf}
    out = []
    for d, size in zip(docs, length):
        w = {t: (x := c * idf[t]) * idf[t] * (k1 + 1) / (x * (k1 * (1 - b + b * size / avg)) + 1) for t, c in Counter(d).items()}
        scale = math.sqrt(sum(x * x for x in w.values())) * math.sqrt(sum(x * x for x in v.values()))
        out.append(sum(v[t] * w[t] for t in v if t in w) / scale if scale else 0.0)
    return out


def test_scores_equal_a_loop_over_terms():
    rng = random.Random(6)
    for _ in range(30):
        docs = [[rng.randint(-9, 30) for _ in range(rng.randint(0, 15))] for _ in range(rng.randint(1, 12))]
        texts = [[rng.randint(-9, 40) for _ in range(rng.randint(0, 6))] for _ in range(3)]
        weights = [1.0, 0.7, 0.0]
        got = corpus_scores([np.array(d, np.int64) for d in docs], [np.array(t, np.int64) for t in texts], weights)
        want = [max(0.0, *(w * s for w, s in zip(weights, of))) for of in zip(*(plain(docs, t) if any(docs) else [0.0] * len(docs) for t in texts))]
        assert got == pytest.approx(want, abs=1e-12)
    assert corpus_scores([], [], []).tolist() == [] and corpus_scores([np.zeros(0, np.int64)], [np.array([1])], [1.0]).tolist() == [0.0]


def test_a_corpus_per_key_equals_the_global_model_of_its_documents(spark):
    texts = [("a", "the heron and the mill"), ("b", ""), ("c", "rye rye heron"), ("d", None), ("e", "old mill")]
    docs = spark.createDataFrame(texts, "doc_id string, content string")
    members = docs.select(F.explode(F.array(F.lit("r"), F.lit("s"))).alias("key"), "doc_id", "content").where("key = 'r' OR doc_id <> 'a'")
    asked = spark.createDataFrame([("r", 1.0, "heron mill"), ("r", 0.5, "rye"), ("n", 1.0, "rye")], "key string, weight double, text string")
    got = best_corpus_scores(members.select("key", "doc_id", hashed_tokens(F.col("content")).alias("tokens")),
                             asked.select("key", "weight", hashed_tokens(F.col("text")).alias("tokens")), "key", "doc_id", 3).collect()
    queries = asked.where("key = 'r'").select("text", "weight")
    every = bm25_query(bm25_fit(docs, [], "doc_id", "content"), queries, ["text", "weight"], "text").collect()
    best = {d: 0.0 for d, _ in texts}
    for r in every:
        best[r["doc_id"]] = max(best[r["doc_id"]], r["weight"] * r["sim"])
    assert {r["doc_id"]: r["best_sim"] for r in got if r["key"] == "r"} == pytest.approx(best)
    assert {r["best_sim"] for r in got if r["key"] == "s"} == {0.0} and not [r for r in got if r["key"] == "n"]
