"""Sources and sinks on scratch folders."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from mnemo.operators.mutations import insert_turns
from mnemo.sources import jsonl, library, personas
from mnemo.sources.store import TurnStore


def _scratch():
    return tempfile.mkdtemp(prefix="mnemo-test-")


def test_library_listing_reading_search(spark):
    root = _scratch()
    with open(os.path.join(root, "notes.md"), "w") as f:
        f.write("Intro\n  The first line  \nother\nTHE end\n")
    with open(os.path.join(root, "bad.txt"), "wb") as f:
        f.write(b"ok \xff\xfe bytes\n")
    with open(os.path.join(root, "image.png"), "wb") as f:
        f.write(b"\x89PNG")
    names = {r.name: r.length for r in library.list_documents(spark, root).collect()}
    assert set(names) == {"notes.md", "bad.txt"}
    texts = {r.name: r.text for r in library.read_documents(spark, root).collect()}
    assert "�" in texts["bad.txt"]
    hits = {r.name: r.lines for r in library.search_library(spark, root, "the").collect()}
    assert hits == {"notes.md": ["The first line", "other", "THE end"]}
    q = spark.createDataFrame([("notes.md",), ("missing.txt",)], "name string")
    assert {r.name: r.exists for r in library.document_exists(spark, root, q).collect()} == {
        "notes.md": True, "missing.txt": False}


def test_personas_and_description(spark):
    root = _scratch()
    with open(os.path.join(root, "p.json"), "w") as f:
        json.dump({"persona_id": "x", "name": "Prof", "default_location": "Lab",
                   "attributes": {"age": 42, "temperament": "calm"}, "features": {"Voice": "dry"}}, f)
    df = personas.load_personas(spark, root)
    row = df.collect()[0]
    assert row.name == "Prof" and row.attributes["age"] == "42"
    desc = personas.persona_description(df).collect()[0].description
    assert desc.startswith("#define Prof [age=42 tem=calm]")
    assert "#define Voice [dry]" in desc


def test_jsonl_roundtrip_and_corrupt_lines(spark):
    root = _scratch()
    path = os.path.join(root, "dump.jsonl")
    with open(path, "w") as f:
        f.write(json.dumps({"doc_id": "d1", "conversation_id": "c1", "role": "user", "content": "hi",
                            "sequence_no": 0}) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({"doc_id": "d3", "conversation_id": "c1", "role": "user", "content": "half", "weight": "abc"}) + "\n")
        f.write(json.dumps({"doc_id": "d2", "conversation_id": "c1", "role": "assistant", "content": "yo",
                            "sequence_no": 1, "weight": 2.0}) + "\n")
    raw = jsonl.read_jsonl(spark, path)
    assert jsonl.bad_lines(raw).count() == 2  # a line that parses in part is not imported, so it is listed
    rows, counts = jsonl.import_dump(spark, path, as_of=100, user_id="u9")
    got = {r.doc_id: r for r in rows.collect()}
    assert got["d1"].weight == 1.0 and got["d2"].weight == 2.0
    assert got["d1"].reference_id == "c1" and got["d1"].user_id == "u9" and got["d1"].timestamp == 100
    assert [(r.conversation_id, r.messages) for r in counts.collect()] == [("c1", 2)]
    out = os.path.join(root, "out")
    jsonl.export_all(rows, out)
    back = jsonl.read_jsonl(spark, out).drop(jsonl.CORRUPT)
    assert back.count() == 2


def _files(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]


def test_request_without_vector_keeps_its_recall(spark):
    from mnemo.operators.memory import memory_query
    store = spark.createDataFrame([("d1", "conversation", "u", "p", "c1", "user", "tea time", 0, 0, 1.0, 5, [0.5, 0.5]),
                                   ("d2", "conversation", "u", "p", "c2", "user", "rain", 0, 0, 1.0, 5, [1.0, 0.0])],
                                  "doc_id string, document_type string, user_id string, persona_id string, conversation_id string, role string, "
                                  "content string, branch int, sequence_no int, weight double, timestamp long, index array<float>")
    req = spark.createDataFrame([("r", None, 5, 0.7, 0.7, True, 10, None)], "request_id string, document_type string, top_n int, turn_decay double, "
                                "temporal_decay double, filter_metadocs boolean, as_of long, exclude_conversation_id string")
    none = spark.createDataFrame([], "request_id string, n int, text string")
    got = memory_query(store, req, none, spark.createDataFrame([], "request_id string, qvec array<double>")).collect()
    assert {r.doc_id for r in got} == {"d1", "d2"} and all(r.score > 0 for r in got)


def test_checkpoint_folder_is_named_on_a_cluster(spark, monkeypatch):
    import pytest

    from mnemo import session

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Cluster())


def test_store_init_append_clear(spark):
    st = TurnStore(spark, os.path.join(_scratch(), "store")).init()
    assert st.size() == 0
    rows = insert_turns(spark.createDataFrame([("d1", "c1", 0, "user", "hello")],
                                              "doc_id string, conversation_id string, sequence_no int, role string, content string"),
                        as_of=5)
    st.append(rows)
    first = {p: os.stat(p).st_mtime_ns for p in _files(st.root)}
    st.append(rows.withColumn("doc_id", F.lit("d2")))
    assert st.size() == 2
    assert all(os.stat(p).st_mtime_ns == t for p, t in first.items()) and set(first) < set(_files(st.root))
    st.append(rows.unionByName(rows).unionByName(rows.withColumn("doc_id", F.lit(None).cast("string"))))
    ids = [r.doc_id for r in st.scan(["doc_id"]).collect()]
    assert len(ids) == 5 == len(set(ids)) and None not in ids
    vectors = st.scan(["index"]).collect()
    assert all(len(v["index"]) == 64 for v in vectors)
    st.append(rows.withColumn("doc_id", F.lit("d9")), batch="b-1").append(rows.withColumn("doc_id", F.lit("d9")), batch="b-1")
    assert st.size() == 6
    st.write(st.scan())
    assert st.size() == 6 and len(st.batches()) == 1
    assert st.scan(["document_type"]).distinct().collect()[0].document_type == "conversation"
    st.clear()
    assert st.size() == 0


def test_store_type_filter_prunes_partitions(spark):
    st = TurnStore(spark, os.path.join(_scratch(), "store")).init()
    rows = insert_turns(spark.createDataFrame(
        [("d1", "c1", 0, "user", "hello", "conversation"), ("d2", "c1", 1, "assistant", "note", "journal")],
        "doc_id string, conversation_id string, sequence_no int, role string, content string, document_type string"),
        as_of=5)
    st.append(rows)
    df = st.scan(["doc_id", "document_type"]).filter(F.col("document_type") == "journal")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(document_type" in plan and "journal" in plan
    assert [r.doc_id for r in df.collect()] == ["d2"]
