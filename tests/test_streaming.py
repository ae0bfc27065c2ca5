"""Streams with checkpoints of their own into one store or output folder."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mnemo.operators.mutations import insert_turns
from mnemo.sources.jsonl import append_jsonl
from mnemo.sources.store import TurnStore
from mnemo.streaming.ingest import start_ingest, turn_stream
from mnemo.streaming.recall import start_recall
from mnemo.streaming.report import compact_updates, current_report, start_report

SCHEMA = "doc_id string, conversation_id string, sequence_no int, role string, content string"


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="mnemo-test-")


def turns_of(spark, *ids, conversation="c1"):
    return insert_turns(spark.createDataFrame([(i, conversation, k, "user", f"hello {i}") for k, i in enumerate(ids)], SCHEMA), as_of=5)


@pytest.mark.parametrize("dedup", [False, True])
def test_two_checkpoints_ingest_into_one_store(spark, root, dedup):
    store = TurnStore(spark, f"{root}/store")
    for k, ids in enumerate((["a", "b"], ["c"], ["d", "e"])):
        source = f"{root}/in-{k % 2}"
        append_jsonl(turns_of(spark, *ids), source)
        start_ingest(spark, source, store.root, f"{root}/checkpoint-{k % 2}/", 5, dedup=dedup).awaitTermination()
    assert sorted(r.doc_id for r in store.scan(["doc_id"]).collect()) == ["a", "b", "c", "d", "e"]
    assert len(set(store.batches())) == 3


def test_two_checkpoints_report_into_one_folder(spark, root):
    out, seen = f"{root}/updates", {}
    for k, (ids, conversation) in enumerate(((["a", "b"], "c1"), (["c"], "c2"), (["d", "e", "f"], "c1"))):
        source = f"{root}/in-{k % 2}"
        append_jsonl(turns_of(spark, *ids, conversation=conversation), source)
        start_report(turn_stream(spark, source), out, f"{root}/checkpoint-{k % 2}").awaitTermination()
        seen[conversation] = seen.get(conversation, 0) + len(ids)
        assert {r.conversation_id: r.conversation for r in current_report(spark, out).collect()} == seen
    compact_updates(spark, out, f"{root}/compact")
    assert {r.conversation_id: r.conversation for r in current_report(spark, f"{root}/compact").collect()} == seen
    append_jsonl(turns_of(spark, "g"), f"{root}/in-0")
    start_report(turn_stream(spark, f"{root}/in-0"), f"{root}/compact", f"{root}/checkpoint-0").awaitTermination()
    assert {r.conversation_id: r.conversation for r in current_report(spark, f"{root}/compact").collect()} == {"c1": 6, "c2": 1}
    # a new checkpoint that reads everything again doesn't count twice
    start_report(turn_stream(spark, f"{root}/in-0"), out, f"{root}/checkpoint-9").awaitTermination()
    assert {r.conversation_id: r.conversation for r in current_report(spark, out).collect()} == {"c1": 6, "c2": 1}


def test_two_checkpoints_recall_into_one_folder(spark, root):
    store = TurnStore(spark, f"{root}/store").init().append(turns_of(spark, "a", "b")).append(turns_of(spark, "c", conversation="c2"))
    for k, i in enumerate("ac"):
        source = f"{root}/in-{k}"
        users = store.scan().where(F.col("doc_id") == i).select("doc_id", "conversation_id", "content")
        users.write.parquet(source)
        start_recall(spark.readStream.schema(users.schema).parquet(source), store.scan(), f"{root}/out", f"{root}/checkpoint-{k}", 5).awaitTermination()
    assert {r.request_id for r in spark.read.parquet(f"{root}/out").collect()} == {"a", "c"}
    assert len([d for d in os.listdir(f"{root}/out") if d.startswith("batch_id=")]) == 2
