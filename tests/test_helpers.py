"""Small column helpers and pipeline pieces."""

from pyspark.sql import functions as F

from mnemo.functions.embed import hashed_embedding
from mnemo.functions.ids import new_ids
from mnemo.functions.text import query_label, wordnet_pos
from mnemo.operators import context as CX
from mnemo.operators import prompts as PL


def test_query_label(spark):
    df = spark.createDataFrame([(0,), (1,), (25,), (26,), (27,)], "n int")
    assert [r.l for r in df.select(query_label("n").alias("l")).collect()] == ["", "b", "z", "ba", "bb"]


def test_hashed_embedding_unit_norm(spark):
    df = spark.createDataFrame([("a b c a",), ("",)], "t string")
    rows = df.select(hashed_embedding("t", 16).alias("v")).collect()
    assert len(rows[0].v) == 16 and abs(sum(x * x for x in rows[0].v) - 1.0) < 1e-6
    assert sum(rows[1].v) == 0.0


def test_new_ids_unique_and_free(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    taken = spark.createDataFrame([("x",)], "doc_id string")
    ids = new_ids(keys, "k", taken, n_words=2)
    rows = ids.collect()
    assert len(rows) == 2000 and len({r.new_id for r in rows}) == 2000


def test_wordnet_pos(spark):
    df = spark.createDataFrame([("runs", "VBZ"), ("the", "DT"), ("3", "CD"), ("zz", "XYZ")], "token string, tag string")
    got = {r.token: r.pos for r in wordnet_pos(df).collect()}
    assert got == {"runs": "v", "the": "r", "zz": "n"}


def test_expand_plan_counts(spark):
    plans = spark.createDataFrame([("a", "chore", "Total Steps: 3"), ("b", "report", "Total Steps: 3"),
                                   ("c", "report", "nothing"), ("d", "chore", "nothing")],
                                  "request_id string, pipeline string, response string")
    counts = {r.request_id: r.n for r in PL.expand_plan(plans).groupBy("request_id").agg(
        F.count("*").alias("n")).collect()}
    assert counts == {"a": 5, "b": 8, "c": 9}
    mids = PL.expand_plan(plans).filter("request_id = 'a' AND ordinal IS NOT NULL").orderBy("step").collect()
    assert [r.ordinal for r in mids] == ["first", "second", "third"] and all(r.task for r in mids)


def test_messages_provider_format_and_system(spark):
    ctx = spark.createDataFrame([("r", "CONTEXT")], "request_id string, text string")
    turns = spark.createDataFrame([("r", 0, "assistant", "earlier")], "request_id string, pos int, role string, content string")
    prompts = spark.createDataFrame([("r", "do it")], "request_id string, prompt string")
    msgs = PL.build_messages(ctx, turns, prompts)
    m = msgs.collect()[0].messages
    assert [(x.role, x.content) for x in m] == [("user", "CONTEXT"), ("assistant", "earlier"), ("user", "do it")]
    sysd = PL.prepend_system(msgs, spark.createDataFrame([("r", "SYS")], "request_id string, system string"))
    assert sysd.collect()[0].messages[0].role == "system"
    prov = PL.to_provider_format(msgs).collect()[0].contents
    assert [(x.role, list(x.parts)) for x in prov][1] == ("model", ["earlier"])


def test_preview_recall_text_frame(spark):
    res = spark.createDataFrame([("r", 1, "d1", 2.0, "x" * 100), ("r", 2, "d2", 1.0, "short")],
                                "request_id string, rank int, doc_id string, score double, content string")
    prev = CX.search_preview(res).collect()
    assert [p.doc_id for p in prev] == ["d2", "d1"] and len(prev[1].preview) == 80
    rec = spark.createDataFrame([("r", 1, "2024-01-01 00:00:00", "hello")], "request_id string, order int, date string, content string")
    txt = CX.format_recall(F.lit("HEAD"), ["think"], rec, "END").collect()[0].text
    assert txt == "HEAD\n\n- think\n\n- 2024-01-01 00:00:00: hello\n\nEND"
    doc = spark.createDataFrame([("u", "n.md", "body")], "u string, n string, t string")
    framed = doc.select(CX.frame_document(F.col("u"), F.col("n"), F.col("t")).alias("f")).collect()[0].f
    assert framed.splitlines()[2] == "Document Length: 4"


def test_blocked_position_equals_row_number(spark):
    from pyspark.sql import Window
    from mnemo.operators.history import blocked_position
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5000).alias("t"))
    got = blocked_position(df, ["k"], ["t"], F.floor(F.col("t") / 97))
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(tuple, got.select("k", "t", "pos").collect())) == sorted(map(tuple, ref.collect()))
