"""Nearest rows by bounds in two passes, and corpora scored in blocks of requests, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemo.operators.dense import _make_nearest, _request_block, dense_candidates, top_k_per_request
from mnemo.operators.sparse import Block, candidate_scores, corpus_scores, hashed_tokens

TYPES = ["conversation", "analysis", "step", None]


def store_rows(n=600, dim=5):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (n, dim)).astype(float)  # many equal distances
    return [(f"d{i:03}", TYPES[i % 4], f"c{i % 40}" if i % 7 else None, vectors[i].tolist()) for i in range(n)]


def request_rows(n=50, dim=5):
    rng = np.random.default_rng(9)
    out = []
    for i in range(n):
        q = None if i == 3 else (rng.integers(-3, 4, dim) / 2).tolist()
        out.append((f"r{i}", q, "analysis" if i % 5 == 0 else None, i % 3 > 0, f"c{i}" if i % 2 else None, f"c{i}" if i % 11 == 0 else None))
    return out


def plain(rows, request, k):
    _, q, doc_type, meta, excl, only = request
    q = np.zeros(5) if q is None else np.array(q)
    ok = [(float(((q - np.array(v)) ** 2).sum()), d) for d, t, c, v in rows
          if not (meta and t == "step") and (doc_type is None or t == doc_type) and (excl is None or c != excl) and (only is None or c == only)]
    return sorted(ok)[:k]


@pytest.mark.parametrize("unbounded", [0, 1000])
def test_bounds_leave_the_same_nearest_rows(spark, unbounded):
    rows, asked = store_rows(), request_rows()
    store = spark.createDataFrame(rows, "doc_id string, document_type string, conversation_id string, index array<float>")
    req = spark.createDataFrame(asked, "request_id string, qvec array<double>, document_type string, filter_metadocs boolean, "
                                       "exclude_conversation_id string, only_conversation_id string")
    found: dict = {}
    for r in top_k_per_request(dense_candidates(store, req, k=20, max_broadcast=30, unbounded=unbounded), k=20).collect():
        found.setdefault(r["request_id"], []).append((r["distance"], r["doc_id"]))
    for request in asked:
        assert sorted(found.get(request[0], [])) == plain(rows, request, 20)


def test_bounded_requests_send_no_more_rows_with_more_tasks(spark):
    store = spark.createDataFrame(store_rows(4000), "doc_id string, document_type string, conversation_id string, index array<float>")
    rng = np.random.default_rng(2)
    store = store.withColumn("index", F.transform("index", lambda x: x + F.rand(5).cast("float")))
    asked = [(f"r{i}", rng.normal(size=5).tolist(), None, False, None) for i in range(20)]
    req = spark.createDataFrame(asked, "request_id string, qvec array<double>, document_type string, filter_metadocs boolean, exclude_conversation_id string")
    # every task of the store scan used to send 100 rows per request
    sent = dense_candidates(store.repartition(16), req, k=100, unbounded=0).count()
    assert 20 * 100 <= sent <= 20 * 100 * 2


def test_a_task_sends_batches_of_bounded_size():
    class Held:
        value = _request_block([{"request_id": f"r{i}", "qvec": [float(i), 0.0], "document_type": None, "filter_metadocs": False,
                                 "exclude_conversation_id": None, "only_conversation_id": None, "k_eff": 1000} for i in range(300)])
    batch = pa.RecordBatch.from_pydict({"doc_id": [f"d{i}" for i in range(1000)], "document_type": ["x"] * 1000, "conversation_id": ["c"] * 1000,
                                        "index": pa.array([[float(i), 1.0] for i in range(1000)], pa.list_(pa.float32()))})
    sizes = [b.num_rows for b in _make_nearest(Held)(iter([batch]))]
    assert sum(sizes) == 300_000 and max(sizes) <= 32768


def test_blocks_score_like_single_corpora_and_join_like_tables(spark):
    texts = {"a": "the heron and the mill", "b": "", "c": "rye rye heron", "d": "old mill"}
    docs = spark.createDataFrame([*texts.items(), ("d", "rye")], "doc_id string, content string")  # d comes twice
    cands = [("r", d, 1.0) for d in "abc"] + [("s", "c", 2.0), ("s", "d", 3.0), (None, "a", 1.0), ("r", None, 1.0)]
    asked = spark.createDataFrame([("r", 1.0, "heron mill"), ("r", 0.5, "rye"), ("s", 1.0, "rye"), ("n", 1.0, "rye")], "request_id string, weight double, text string")
    got = candidate_scores(spark.createDataFrame(cands, "request_id string, doc_id string, distance double"),
                           docs.select("doc_id", hashed_tokens(F.col("content")).alias("tokens"), F.char_length("content").alias("clen")),
                           asked.select("request_id", "weight", hashed_tokens(F.col("text")).alias("tokens")), 3).collect()
    number = {w: i for i, w in enumerate("the heron and mill rye old".split())}

    def arrays(*all_texts):
        return [np.array([number[w] for w in t.split()], np.int64) for t in all_texts]

    want_r = corpus_scores(arrays(*(texts[d] for d in "abc")), arrays("heron mill", "rye"), [1.0, 0.5])
    assert {r["doc_id"]: r["best_sim"] for r in got if r["request_id"] == "r"} == pytest.approx(dict(zip("abc", want_r)))
    want_s = corpus_scores(arrays(texts["c"], "old mill", "rye"), arrays("rye"), [1.0])
    of_d = sorted((r["clen"], round(r["best_sim"], 9)) for r in got if (r["request_id"], r["doc_id"]) == ("s", "d"))
    assert of_d == sorted((n, round(s, 9)) for n in (8, 3) for s in want_s[1:])  # both rows with both scores, as joins by doc_id give them
    assert {r["request_id"] for r in got} == {"r", "s"}


def test_a_task_of_many_documents_holds_only_their_counts(spark):
    """Documents come in batches, and no batch's tokens are kept; an attribute may be called as a column of the texts."""
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 50, 200) for _ in range(300)]
    docs = pa.table({"doc_id": [f"d{i}" for i in range(300)], "tokens": pa.array([t.tolist() for t in tokens], pa.list_(pa.int64())), "weight": [float(i) for i in range(300)]})
    block = Block(["weight"])
    for a in range(0, 300, 100):
        block.add(docs.slice(a, 100))
    block.close()
    assert block.table.terms.nbytes + block.table.tf.nbytes <= 5 * 50 * 300 < 8 * 200 * 300
    asked = pa.table({"_request": ["r", "r"], "_docs": [None, [f"d{i}" for i in range(0, 300, 7)]], "_distances": [None, [float(i) for i in range(0, 300, 7)]],
                      "_weight": [1.0, None], "tokens": pa.array([[1, 2, 2, 99], None], pa.list_(pa.int64()))})
    got = pa.concat_tables(block.scores(asked)).to_pydict()
    assert got["weight"] == got["distance"] == [float(i) for i in range(0, 300, 7)]
    assert got["best_sim"] == pytest.approx(corpus_scores(tokens[::7], [np.array([1, 2, 2, 99])], [1.0]).tolist())


def test_each_block_of_requests_is_a_task_of_its_own(spark):
    rows = spark.range(64).select(F.concat(F.lit("r"), "id").alias("request_id"), F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(1.0).alias("distance"))
    docs = rows.select("doc_id", F.array(F.xxhash64("doc_id")).alias("tokens"), F.lit(2.0).alias("weight"))
    texts = rows.select("request_id", F.lit(1.0).alias("weight"), F.array(F.xxhash64("doc_id")).alias("tokens"))
    got = candidate_scores(rows, docs, texts, 8).withColumn("task", F.spark_partition_id()).withColumn("block", F.pmod(F.xxhash64("request_id"), F.lit(8))).collect()
    assert len(got) == 64 and {r["best_sim"] for r in got} == {1.0} and {r["weight"] for r in got} == {2.0}
    assert all(r["task"] == r["block"] for r in got)
