"""Stores in packs: searches that are told too small a bound, documents without ids or with the same one, what is sent and kept."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators import dense
from mnemo.operators.block_scores import RequestBlock
from mnemo.operators.dense import _request_block, _within_bounds, dense_candidates, find_nearest, nearest_requests, top_k_per_request
from mnemo.operators.memory import memory_query
from mnemo.operators.recall_store import RecallStore
from mnemo.operators.sparse import corpus_scores, rows_scores, term_rows

STORE = ("doc_id string, document_type string, user_id string, persona_id string, conversation_id string, branch int, sequence_no int, role string, "
         "content string, weight double, timestamp long, index array<float>")
REQUESTS = "request_id string, document_type string, top_n int, turn_decay double, temporal_decay double, filter_metadocs boolean, as_of long, exclude_conversation_id string"
WORDS = "heron mill rye old river stone wind lamp".split()


def store_rows(n=300, dim=4):
    rng = np.random.default_rng(3)
    return [(f"d{i:03}" if i % 50 else None, "journal" if i % 3 else "analysis", "u", "p", f"c{i % 20}", 0, i, "user", " ".join(rng.choice(WORDS, 6)) if i % 9 else None,
             1.0 + i % 4 / 10, 1000 * i, rng.integers(-3, 4, dim).astype(float).tolist()) for i in range(n)]


def nearest(rows, q, k, ok):
    found = sorted((float(((np.array(q) - np.array(r[-1])) ** 2).sum()), r[0] or "") for r in rows if ok(r))
    return found[:k]


@pytest.mark.parametrize("sample_rows", [20, 100_000])
def test_requests_that_were_told_too_small_a_bound_ask_again(spark, monkeypatch, sample_rows):
    told, rows = dense._told_bounds, store_rows()

    def too_small(blk, sample, share, widen):
        return told(blk, sample, share, widen) * (0.2 if widen == 1 else 1.0)

    monkeypatch.setattr(dense, "_told_bounds", too_small)
    store = RecallStore(spark.createDataFrame(rows, STORE), with_terms=False)
    asked = [(f"r{i}", [float(x) for x in np.random.default_rng(i).integers(-2, 3, 4)], "analysis" if i % 4 == 0 else None, True, f"c{i % 20}") for i in range(30)]
    req = nearest_requests(spark.createDataFrame(asked, "request_id string, qvec array<double>, document_type string, filter_metadocs boolean, exclude_conversation_id string"), 25)
    found = spark.read.schema(dense.FOUND_SCHEMA).parquet(find_nearest(store, req.cache(), 25, 3, with_ids=True, sample_rows=sample_rows)).where("NOT short").collect()
    assert len(found) == 30
    for r in found:
        _, q, kind, _, conv = asked[int(r["request_id"][1:])]
        want = nearest(rows, q, 25, lambda x: (kind is None or x[1] == kind) and x[4] != conv)
        distances, codes = np.frombuffer(r["distances"], float), np.frombuffer(r["codes"], np.int64)
        assert distances.tolist() == [d for d, _ in want]
        assert [dense.as_table(dense.pa.scalar(bytes(r["ids"]), dense.pa.binary()))["doc_id"][i].as_py() or "" for i in range(len(codes))] == [d for _, d in want]
        assert all((code < 0) == (d == "") for code, (_, d) in zip(codes, want))
    store.close()


def test_single_precision_rules_out_no_row_within_a_bound():
    rng = np.random.default_rng(5)
    for scale, shift in ((1.0, 0.0), (1e-4, 1000.0), (1e18, 0.0), (1e-25, 0.0)):
        mat = (rng.normal(size=(700, 16)) * scale + shift).astype(np.float32)
        q = rng.normal(size=(40, 16)) * scale + shift
        exact = ((q[:, None, :] - mat[None].astype(float)) ** 2).sum(axis=2)
        bound = np.sort(exact, axis=1)[:, 9]
        blk = _request_block([{"request_id": str(i), "qvec": q[i].tolist(), "document_type": None, "filter_metadocs": False, "exclude_conversation_id": None,
                               "only_conversation_id": None, "k_eff": 10, "bound": bound[i]} for i in range(40)])
        table = dense.pa.table({"document_type": ["x"] * 700, "conversation_id": ["c"] * 700, "index": dense.pa.array(mat.tolist(), dense.pa.list_(dense.pa.float32()))})
        got = {(int(blk["ids"][r]), c) for rr, cc, _ in _within_bounds(blk, table) for r, c in zip(rr.tolist(), cc.tolist())}
        assert got >= {(i, j) for i in range(40) for j in np.argsort(exact[i], kind="stable")[:10].tolist()}


def test_many_requests_are_ranked_when_they_are_found(spark):
    rows = [r for r in store_rows() if r[0]]
    asked = [(f"r{i}", [float(i % 3), 0.5, -1.0, 0.0], None, False, None) for i in range(40)]
    req = spark.createDataFrame(asked, "request_id string, qvec array<double>, document_type string, filter_metadocs boolean, exclude_conversation_id string")
    found = dense_candidates(spark.createDataFrame(rows, STORE), req, k=30, unbounded=10)
    assert found.count() == 40 * 30  # no row more than asked for is sent on
    got = top_k_per_request(found, k=10).where("request_id = 'r4'").orderBy("rank").collect()
    assert [(r["distance"], r["doc_id"]) for r in got] == nearest(rows, asked[4][1], 10, lambda r: True)


def test_only_rows_that_can_be_among_the_best_are_scored_in_full():
    rng = np.random.default_rng(8)
    for _ in range(50):
        docs = [rng.integers(0, 30, rng.integers(0, 12)) for _ in range(60)]
        texts, weights = [rng.integers(0, 35, 5) for _ in range(3)], [1.0, 0.7, 0.0]
        factors = rng.choice([0.0, 0.5, 1.0, 3.0], 60) * rng.random(60)
        every = corpus_scores(docs, texts, weights)
        table = term_rows(np.r_[0, np.cumsum([len(d) for d in docs])], np.concatenate(docs))
        some = rows_scores(table, np.arange(60), texts, weights, factors=factors, top_n=4)
        assert np.sort(some * factors)[-4:] == pytest.approx(np.sort(every * factors)[-4:])
        assert all(s == 0 or s == pytest.approx(e) for s, e in zip(some, every))
        assert rows_scores(table, np.arange(60), texts, weights) == pytest.approx(every)  # nothing is left behind


def test_ties_are_kept_by_the_smallest_ids():
    score, code = np.array([0.0, 2.0, 0.0, 1.0, 0.0]), np.array([9, 5, 3, 4, 1])
    assert RequestBlock._best(score, code, 3).tolist() == [1, 3, 4]
    assert RequestBlock._best(np.array([1.0, 1.0 + 1e-12, 0.5]), np.array([1, 2, 3]), 1).tolist() == [0, 1]  # too close to tell here
    assert RequestBlock._best(np.array([1.0, np.nan, 2.0]), np.array([1, 2, 3]), 1).tolist() == [0, 1, 2]


def test_requests_after_documents_are_an_error():
    block = RequestBlock(np.array([0]))
    block.found["r"], block.needed = (np.zeros(0, np.int64), np.zeros(0)), np.zeros(0, np.int64)
    null = {"short": dense.pa.nulls(1, dense.pa.bool_())} | {c: [None] for c in ("codes", "distances", "weight", "tokens", "is_text", "temporal_decay", "as_of", "top_n", "terms", "dictionary")}
    with pytest.raises(RuntimeError):
        block.add(dense.pa.table({"request_id": ["s"], **null}))


def test_left_out_documents_are_replaced_and_nothing_is_left_on_disk(spark):
    rows = [r for r in store_rows() if r[0]]
    store = spark.createDataFrame(rows, STORE).cache()
    req = spark.createDataFrame([("r", None, None, 0.7, 0.1, True, 400_000, None)], REQUESTS)
    texts = spark.createDataFrame([("r", 0, "heron mill")], "request_id string, n int, text string")
    vectors = spark.createDataFrame([("r", [0.0, 1.0, 0.0, 0.0])], "request_id string, qvec array<double>")
    near = nearest(rows, [0.0, 1.0, 0.0, 0.0], 30, lambda r: True)
    began = time.time()
    gone = [near[i][1] for i in (0, 7, 11)]
    folder = spark.conf.get("spark.checkpoint.dir")
    got = memory_query(store, req, texts, vectors, spark.createDataFrame([("r", g) for g in gone], "request_id string, doc_id string"), k=20).collect()
    assert {r["doc_id"] for r in got} == {d for _, d in near if d not in gone} & {d for _, d in nearest(rows, [0.0, 1.0, 0.0, 0.0], 23, lambda r: True)}
    assert sorted(r["rank"] for r in got) == list(range(1, 21))
    assert not [x for x in os.listdir(folder) if x.split("-")[0] in ("packs", "found", "asked", "scored") and os.path.getmtime(os.path.join(folder, x)) > began]


def test_tasks_read_packs_and_shuffle_no_documents(spark):
    """A block of requests used to get its documents' tokens through a shuffle of its own."""
    rows = [r for r in store_rows() if r[0]]
    store = RecallStore(spark.createDataFrame(rows, STORE))
    packs = store.packs().collect()
    assert sum(r["n"] for r in packs) == len(rows) == store.n_vectors
    held = [d for r in packs if r["terms"] is not None for d in dense.as_table(dense.pa.scalar(bytes(r["terms"]), dense.pa.binary()))["doc_id"].to_pylist()]
    assert sorted(held) == [r[0] for r in rows]
    codes = {r["doc_id"]: r["code"] for r in store.codes().collect()}
    assert sorted(codes, key=codes.get) == sorted(codes)
    only = RecallStore(spark.createDataFrame(rows, STORE), wanted=F.col("document_type") == "analysis", with_terms=False)
    assert only.n_vectors == sum(r[1] == "analysis" for r in rows)
    store.close()
    only.close()
