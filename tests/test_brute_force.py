"""Spark operators against plain Python loops written from the reference semantics."""

import re

import pandas as pd

from mnemo.operators import documents as D
from mnemo.operators import turns as TO
from mnemo.plans.views import session_events

from .conftest import SF_CHECK


# hand-worked: text -> phrases (a phrase has up to three capitalised words in a row, never a sentence's first word)
PHRASES = {
    "": set(),
    "Rain fell on Lower Town. Rain fell.": {"Lower Town"},
    "we met Ada, Bo and Cy Dee Ef Gi there": {"Ada Bo", "Cy Dee Ef", "Gi"},
    "He saw it! Then Max came? yes Max": {"Max"},
    "the iPhone and a MacBook in Rome": {"MacBook", "Rome"},
    "Only Opening Words. Matter Little": {"Opening Words", "Little"},
    "a B c D1 Ee_f": set(),
}


def test_capitalized_phrases_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(PHRASES)), "doc_id int, text string")
    got = {i: set() for i in range(len(PHRASES))}
    for r in D.capitalized_phrases(docs, "doc_id", "text").collect():
        got[r.doc_id].add(r.phrase)
    assert got == dict(enumerate(PHRASES.values()))


def test_capitalized_phrases_properties(spark):
    """Every phrase stands in its text up to separators, has one to three words with a
    capital first letter (or mixed capitals), and lower-casing the text removes them all."""
    pdf = pd.read_parquet(f"{SF_CHECK}/documents.parquet", columns=["doc_id", "text"]).dropna()
    texts = {d: re.sub(r"\W+", " ", t) for d, t in zip(pdf.doc_id, pdf.text)}
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text")
    rows = D.capitalized_phrases(docs, "doc_id", "text").collect()
    assert len(rows) > len(texts)
    for r in rows:
        words = r.phrase.split(" ")
        assert 1 <= len(words) <= 3 and r.phrase in texts[r.doc_id] and all(re.search("[A-Z]", w) for w in words)
    lower = docs.selectExpr("doc_id", "lower(text) AS text")
    assert D.capitalized_phrases(lower, "doc_id", "text").count() == 0


def number_turns_loop(actions):
    """The chat loop's numbering: returns (sequence_no, branch) per accepted pair."""
    seq, branch, pairs, out = 0, 0, 0, []
    for a in actions:
        if a == "new":
            seq, branch, pairs = 0, 0, 0
        elif a == "back":
            branch += 1
            pairs = max(pairs - 1, 0)
        elif a == "retry":
            if pairs >= 1:
                branch += 1
                pairs -= 1
        elif a == "assistant":
            out.append((seq, branch))
            seq += 2
            pairs += 1
    return out


def test_number_turns_equal_loop(spark):
    ev = session_events(spark, SF_CHECK).toPandas().sort_values(["session", "ts", "event_id"])
    expect = []
    for s, g in ev.groupby("session", sort=True):
        expect += [(s, *p) for p in number_turns_loop(list(g.action))]
    got = TO.number_turns(session_events(spark, SF_CHECK)).collect()
    assert sorted((r.session, r.sequence_no, r.branch) for r in got) == sorted(expect)


def test_number_turns_hot_session_blocked(spark):
    """Every event in one session (a hot key): the blocked scan equals the loop."""
    from pyspark.sql import functions as F
    ev = session_events(spark, SF_CHECK).withColumn("session", F.lit(7).cast("long"))
    pdf = ev.toPandas().sort_values(["ts", "event_id"])
    expect = sorted((7, *p) for p in number_turns_loop(list(pdf.action)))
    for width in (60, 3600):
        got = TO.number_turns_blocked(ev, block_seconds=width).collect()
        assert sorted((r.session, r.sequence_no, r.branch) for r in got) == expect
    # adaptive blocks: the hot session is cut into ~500-event blocks
    got = TO.number_turns_blocked(ev, block_rows=500).collect()
    assert sorted((r.session, r.sequence_no, r.branch) for r in got) == expect


def test_history_lookup_limit_binds(spark):
    """With a limit below the conversation length only the nearest rows remain."""
    import numpy as np
    from pyspark.sql import functions as F

    from mnemo.operators.history import conversation_history_for_query
    from mnemo.plans.views import chat_requests, request_vectors, turns
    store = turns(spark, SF_CHECK, with_vectors=True)
    _r, texts = chat_requests(turns(spark, SF_CHECK))
    q = request_vectors(store, texts).withColumn("conversation_id", F.col("request_id"))
    got = conversation_history_for_query(store, q, limit=3).select("request_id", "doc_id").collect()
    rows = store.select("doc_id", "conversation_id", "index").toPandas()
    qv = {r.request_id: np.asarray(r.qvec, dtype=np.float64) for r in q.collect()}
    expect = set()
    for rid, vec in qv.items():
        part = rows[rows.conversation_id == rid]
        d = [(float(((np.asarray(v, dtype=np.float64) - vec) ** 2).sum()), doc) for doc, v in zip(part.doc_id, part["index"])]
        expect |= {(rid, doc) for _, doc in sorted(d)[:3]}
    got_set = {(r.request_id, r.doc_id) for r in got}
    # the newest-branch filter may drop some of the nearest rows, never add others
    assert got_set <= expect and len(got_set) >= len(qv)
