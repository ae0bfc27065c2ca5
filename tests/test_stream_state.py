"""Streams whose state is evicted: sessions, conversations and ids that come back later."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemo.functions.embed import hashed_embedding
from mnemo.operators.dense import mean_vectors
from mnemo.operators.memory import recall_bundle
from mnemo.operators.mutations import insert_turns
from mnemo.operators.turns import number_turns
from mnemo.sources.jsonl import append_jsonl
from mnemo.sources.store import TurnStore
from mnemo.streaming.chat import CLOSED_SCHEMA, start_chat_recall
from mnemo.streaming.ingest import start_ingest
from mnemo.streaming.turns import ROW_COLUMNS, ROW_SCHEMA, Stretch, completed, numbered_pairs, start_numbering, stored_states

ACTIONS = ["user", "assistant", "assistant", "back", "retry", "retry", "new"]


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="mnemo-test-")


def plain(actions):
    seq = branch = pairs = 0
    out = []
    for i, a in enumerate(actions):
        if a == "new":
            seq = branch = pairs = 0
        elif a == "back":
            branch, pairs = branch + 1, max(pairs - 1, 0)
        elif a == "retry" and pairs:
            branch, pairs = branch + 1, pairs - 1
        elif a == "assistant":
            out.append((i, seq, branch))
            seq, pairs = seq + 2, pairs + 1
    return out, (seq, branch, pairs)


def test_stretches_complete_each_other(spark):
    rng = random.Random(4)
    sessions = [[rng.choice(ACTIONS[:7 if s % 3 else 6]) for _ in range(rng.randint(0, 40))] for s in range(300)]
    cuts = [sorted(rng.randint(0, len(a)) for _ in range(2)) for a in sessions]
    before, got = spark.createDataFrame([], "session long, seq long, branch long, pairs long"), []
    for part in range(3):
        rows = []
        for s, actions in enumerate(sessions):
            ends = [0, *cuts[s], len(actions)]
            state = Stretch()
            for i in range(ends[part], ends[part + 1]):
                if state.apply(actions[i]):
                    rows.append((s, False, i, *state.row()))
                    state.accept()
            rows.append((s, True, 0, *state.row()))
        done = completed(spark.createDataFrame(rows, ROW_SCHEMA).select(*ROW_COLUMNS), before).collect()
        got += [(r["session"], r["event_id"], r["seq"], r["branch"]) for r in done if not r["evicted"]]
        finals = [(r["session"], r["seq"], r["branch"], r["pairs"]) for r in done if r["evicted"]]
        before = spark.createDataFrame(finals, before.schema)
    assert Counter(got) == Counter((s, *p) for s, a in enumerate(sessions) for p in plain(a)[0])
    assert sorted(finals) == [(s, *plain(a)[1]) for s, a in enumerate(sessions)]


def test_evicted_sessions_go_on_from_their_stored_state(spark, root):
    rng = random.Random(8)
    # three bursts an hour apart; session 0 takes part in all, others skip some, session 1 never stops
    rows, event = [], 0
    for burst in range(3):
        for k in range(60):
            for session in (0, *([2] if burst != 1 else []), *([3] if burst else [])):
                event += 1
                rows.append((session, burst * 7200 + k, event, rng.choice(ACTIONS[:6])))
    rows += [(1, t, 10_000 + t, rng.choice(ACTIONS[:6])) for t in range(0, 14_460, 300)]
    df = spark.createDataFrame(rows, "session long, at long, event_id long, action string").select(
        "session", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), "event_id", "action")
    out, source = f"{root}/out", f"{root}/in"
    for burst in range(3):
        at = F.col("ts").cast("long") - 1_700_000_000
        df.where((at >= burst * 7200) & (at < (burst + 1) * 7200)).coalesce(1).write.mode("append").parquet(source)
        start_numbering(spark.readStream.schema(df.schema).parquet(source), out, f"{root}/checkpoint", idle_seconds=600, delay="0 seconds").awaitTermination()
        if burst == 1:  # session 2 has been away since the first burst, and 0 and 3 since a moment ago
            assert {r["session"] for r in stored_states(spark, out).collect()} >= {0, 2}
            assert 1 not in {r["session"] for r in stored_states(spark, out).collect()}
    want = number_turns(df)
    assert Counter(map(tuple, numbered_pairs(spark, out).collect())) == Counter(map(tuple, want.select("session", "event_id", "sequence_no", "branch").collect()))


def test_chat_recall_equals_the_batch_for_every_turn(spark, root):
    words = "heron mill rye bread dark grind nest old river bank boat sail".split()
    rng = random.Random(3)
    turns = []
    for c in range(4):
        for k in range(rng.randint(3, 8)):
            turns.append((f"c{c}-{k}", f"c{c}", f"p{c % 2}", "user" if k % 2 == 0 else "assistant", " ".join(rng.choices(words, k=6)), 1_700_000_000 + k * 86_400 + c))
    turns.append(("c0-s", "c0", "p0", "system", "be kind", 1_700_000_000))
    df = spark.createDataFrame(turns, "doc_id string, conversation_id string, persona_id string, role string, content string, timestamp long")
    base = insert_turns(df.withColumn("document_type", F.when(F.col("doc_id").isin("c1-1", "c2-1"), "journal").otherwise("conversation")).withColumn("sequence_no", F.lit(0)), 5)
    # the newest turns aren't stored: they ask with a vector of their own
    store = base.where("doc_id NOT LIKE '%-4'").withColumn("index", hashed_embedding("content"))
    source, out = f"{root}/in", f"{root}/out"
    stream_rows = df.withColumn("ts", F.timestamp_seconds("timestamp")).drop("timestamp")
    day = (F.col("timestamp") - 1_700_000_000) / 86_400
    for first, last in ((0, 2), (2, 3), (3, 99)):
        stream_rows.join(df.where((day >= first) & (day < last)).select("doc_id"), "doc_id", "left_semi").write.mode("append").parquet(source)
        start_chat_recall(spark.readStream.schema(stream_rows.schema).parquet(source), store, out, f"{root}/checkpoint", 1_700_900_000,
                          memory_window=4, recall_size=1, delay="0 seconds").awaitTermination()
    assert spark.read.schema(CLOSED_SCHEMA).parquet(f"{out}/closed").count() > 0

    texts = {"assistant": [], "user": []}
    for i, c, _, role, _, at in turns:
        if role == "user":
            for r in texts:
                earlier = sorted(((t, d, x) for d, cc, _, rr, x, t in turns if cc == c and rr == r and (t, d) <= (at, i)), reverse=True)
                texts[r] += [(i, n, x, d) for n, (_, d, x) in enumerate(earlier)]
    asked = {r: spark.createDataFrame(rows, "request_id string, n int, text string, doc_id string") for r, rows in texts.items()}
    vectors = df.select("doc_id", hashed_embedding("content").alias("index"))
    of = [x for r in ("assistant", "user") for x in (asked[r].drop("doc_id"), mean_vectors(vectors, asked[r].select("request_id", "doc_id")))]
    chats = df.where("role = 'user'").select(F.col("doc_id").alias("request_id"), "persona_id", "conversation_id", F.lit(1_700_900_000).cast("long").alias("as_of"))
    want = recall_bundle(store, chats, *of, 4, 1)
    key = ["request_id", "source", "rank", "doc_id"]

    def rows(d):
        return sorted((*[r[k] for k in key], round(r["score"], 9)) for r in d.collect())

    got = rows(spark.read.parquet(f"{out}/memories"))
    assert got == rows(want) and len({g[0] for g in got}) == sum(t[3] == "user" for t in turns)


def test_copies_are_stored_once_and_late_turns_kept(spark, root):
    store, source = TurnStore(spark, f"{root}/store"), f"{root}/in"

    def arrive(window, *rows):
        df = spark.createDataFrame([(i, "c", k, "user", f"text {i}", at) for k, (i, at) in enumerate(rows)],
                                   "doc_id string, conversation_id string, sequence_no int, role string, content string, timestamp long")
        append_jsonl(insert_turns(df, 5), source)
        start_ingest(spark, source, store.root, f"{root}/checkpoint", 5, dedup=True, embed=None, window=window).awaitTermination()

    arrive("1 hour", ("a", 900), ("a", 900), ("b", 800))
    arrive("1 hour", ("a", 900), ("c", 10))  # a copy within the window; a turn far behind the others
    arrive("1 hour", (None, 5), (None, 5), ("d", 1), ("b", 800))
    ids = [r.doc_id for r in store.scan(["doc_id"]).collect()]
    assert len(ids) == 6 == len(set(ids)) and {"a", "b", "c", "d"} < set(ids)


def test_ids_older_than_the_window_are_looked_up(spark, root):
    store = TurnStore(spark, f"{root}/store").init()
    rows = insert_turns(spark.createDataFrame([("a", "c", 0, "user", "x"), ("b", "c", 1, "user", "y")],
                                              "doc_id string, conversation_id string, sequence_no int, role string, content string"), 5)
    store.append(rows, embed=None)
    append_jsonl(rows, f"{root}/in")
    start_ingest(spark, f"{root}/in", store.root, f"{root}/checkpoint", 5, dedup=True, embed=None, window="0 seconds").awaitTermination()
    assert sorted(r.doc_id for r in store.scan(["doc_id"]).collect()) == ["a", "b"]


def test_numbering_calls_by_bucket_and_takes_null_ids(spark, root):
    rng = random.Random(21)
    big = 2 ** 53 + 1  # ids that a float can't hold
    names, events = [None, 0, *(big + s for s in range(200))], []
    for k, s in enumerate(names):  # some come once, some in all bursts, some (the null session) miss the second one
        for burst in ((0, 2), (0,), (0, 1, 2), (0,))[k % 4]:
            events += [(s, burst * 7200 + t, None if t == 9 else big + 1000 * k + 100 * burst + t, rng.choice(ACTIONS)) for t in range(10)]
    df = spark.createDataFrame(events, "session long, at long, event_id long, action string").select(
        "session", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), "event_id", "action")
    out, source, held = f"{root}/out", f"{root}/in", []
    for burst in range(3):
        df.where(f"floor((unix_timestamp(ts) - 1700000000) / 7200) = {burst}").coalesce(1).write.mode("append").parquet(source)
        q = start_numbering(spark.readStream.schema(df.schema).parquet(source), out, f"{root}/checkpoint", idle_seconds=600, delay="0 seconds", buckets=4)
        q.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= 4
    want = Counter()
    for s in names:
        mine = [(at, e, a) for x, at, e, a in events if x == s]
        want.update((s, mine[i][1], seq, branch) for i, seq, branch in plain([a for _, _, a in mine])[0])
    assert Counter(map(tuple, numbered_pairs(spark, out).collect())) == want
    away = {r["session"] for r in stored_states(spark, out).collect()}
    assert away >= {*names[1::2], None}
