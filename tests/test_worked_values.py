"""Hand-worked values (FIXTURES.md section 3) and small ordered cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemo.functions.scoring import memory_score, turn_decay
from mnemo.functions.text import total_steps
from mnemo.operators import documents as D
from mnemo.operators import sparse as S
from mnemo.operators import turns as TO

DOCS = [
    "Kettles boil water in the small kitchen.",
    "Boiled water cools faster in a covered pot than in the kettles.",
    "The kitchen garden grows mint and thyme.",
]
QUERIES = ["Which kettles boil the water?", "What grows in a garden?", "zzz"]
# worked from the formulas, query by document
SIMS = [[0.712535064, 0.251787016, 0.054116999], [0.126143239, 0.280261713, 0.451149998], [0.0, 0.0, 0.0]]


def test_bm25_toy_corpus(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "doc_id int, text string")
    qs = spark.createDataFrame([(i, t) for i, t in enumerate(QUERIES)], "qid int, text string")
    model = S.bm25_fit(docs, [], "doc_id", "text", tokenizer=lambda c: F.regexp_extract_all(
        F.lower(c), F.lit("[a-z0-9]+"), 0))
    sims = {(r.qid, r.doc_id): r.sim for r in S.bm25_query(
        model, qs, ["qid"], "text", tokenizer=lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    ).collect()}
    for q, row in enumerate(SIMS):
        assert [sims.get((q, d), 0.0) for d in range(3)] == pytest.approx(row, abs=1e-8)
    norms = {r.doc_id: r.dn for r in model.norms.collect()}
    assert set(norms) == {0, 1, 2}


def test_memory_score_worked_rows(spark):
    rows = [Row(d=0.5, s=0.8, w=1.0, n=100, age=0), Row(d=1.0, s=0.8, w=1.3, n=400, age=7 * 86400),
            Row(d=2.0, s=0.0, w=1.0, n=64, age=86400)]
    df = spark.createDataFrame(rows)
    now = 1700000000
    out = df.select(memory_score(F.col("s"), F.col("d"), F.col("w"), F.col("n"), F.lit(0.7),
                                 F.lit(now) - F.col("age"), F.lit(now)).alias("score")).collect()
    got = [r.score for r in out]
    assert got[0] == pytest.approx(4.586313713864835, rel=1e-12)
    assert got[1] == pytest.approx(2.490278572974373, rel=1e-12)
    assert got[2] == 0.0


def test_turn_decay_zero_power(spark):
    df = spark.range(3).select(F.col("id").alias("n"))
    assert [r.v for r in df.select(turn_decay(F.lit(0.0), "n").alias("v")).orderBy("n").collect()] == [1.0, 0.0, 0.0]
    got = [r.v for r in df.select(turn_decay(F.lit(0.7), "n").alias("v")).orderBy("n").collect()]
    assert got == pytest.approx([1.0, 0.7, 0.49])


def test_total_steps_cases(spark):
    df = spark.createDataFrame([("Total Steps: 4",), ("steps total:12",), ("Total Steps: [4]",),
                                ("Total Steps: 3 and Total Steps: 9",), ("nothing",)], "t string")
    assert [r.v for r in df.select(total_steps("t").alias("v")).collect()] == [4, 12, None, 3, None]


def test_chunk_words_counts(spark):
    texts = [" ".join(["w"] * 256), " ".join(["w"] * 257), ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    counts = {r.id: r.n for r in D.chunk_words(df, "id", "t").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 2, 1: 3, 2: 1}


def test_capitalized_phrases_example(spark):
    df = spark.createDataFrame([(0, "The North Sea Ferry Office sold a LoRa radio. Anna left. USB and TV too.")],
                               "id int, t string")
    got = {r.phrase for r in D.capitalized_phrases(df, "id", "t").collect()}
    # at most three words a phrase; sentence openers don't count; three capitals don't match, two do
    assert got == {"North Sea Ferry", "Office", "LoRa", "TV"}
    expanded = {r.phrase for r in D.capitalized_ngrams(df, "id", "t").collect()}
    assert {"Office", "Offices", "LoRas", "TVs"} <= expanded


@pytest.mark.parametrize("roles,expected", [
    ("u a u a u a u a u", 6), ("u a u", 2), ("u a u a u a u", 6)])
def test_insert_at_fold(spark, roles, expected):
    names = {"u": "user", "a": "assistant"}
    rows = [("c", i, names[r], f"t{i}") for i, r in enumerate(roles.split())]
    df = spark.createDataFrame(rows, "key string, pos int, role string, content string")
    out = TO.insert_at_fold(df, "key", "pos", "X").orderBy("pos").collect()
    changed = [r.pos for r in out if r.content.startswith("X")]
    assert changed == [expected]


def test_number_turns_small(spark):
    acts = "user assistant user assistant back user assistant".split()
    df = spark.createDataFrame([(1, i, i, a) for i, a in enumerate(acts)],
                               "session int, ts int, event_id int, action string")
    got = [(r.sequence_no, r.branch) for r in TO.number_turns(df).orderBy("event_id").collect()]
    assert got == [(0, 0), (2, 0), (4, 1)]


def test_token_f1_values(spark):
    from mnemo.operators.evaluation import token_f1
    pairs = [("Where does the river meet the old bridge?", "The old bridge was rebuilt after the flood.", 3 / 7),
             ("Where does the river meet the old bridge?", "A river needs no bridge (or two).", 2 / 7),
             ("Where does the river meet the old bridge?", "Nothing in common.", 0.0), ("", "x", 0.0)]
    df = spark.createDataFrame([(i, q, c) for i, (q, c, _) in enumerate(pairs)], "i int, q string, c string")
    tok = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    got = [r.f for r in df.select("i", token_f1(tok("q"), tok("c")).alias("f")).orderBy("i").collect()]
    assert got == pytest.approx([f for _, _, f in pairs], abs=1e-8)


def test_token_ngrams(spark):
    from mnemo.functions.text import token_ngrams
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r.g for r in df.select(token_ngrams("t").alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_expand_plan_bounds(spark):
    from mnemo.operators import prompts as PL
    plans = spark.createDataFrame([("z", "report", "Total Steps: 0"), ("z", "chore", "Total Steps: 0"), ("m", "chore", "Total Steps: 15"),
                                   ("x", "chore", "Total Steps: 16"), ("x", "report", "Total Steps: 99999999"), ("n", "report", None)],
                                  "request_id string, pipeline string, response string")
    steps = {}
    for r in PL.expand_plan(plans).collect():
        steps.setdefault((r.request_id, r.pipeline), []).append(r.step)
    assert {k: sorted(v) for k, v in steps.items()} == {("z", "report"): list(range(1, 10)), ("m", "chore"): list(range(1, 18)),
                                                        ("x", "report"): list(range(1, 10)), ("n", "report"): list(range(1, 10))}
    assert {(r.request_id, r.pipeline, r.announced) for r in PL.rejected_plans(plans).collect()} == {
        ("z", "report", 0), ("z", "chore", 0), ("x", "chore", 16), ("x", "report", 99999999)}
