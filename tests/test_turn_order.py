"""Turns taken back, role texts with a new input, positions of new chats."""

import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators.reports import resume_position
from mnemo.operators.turns import number_turns, number_turns_blocked, rewound_turns, split_by_role

ACTIONS = ["user", "assistant", "assistant", "back", "retry", "new"]


def plain(events):
    """(event, sequence_no, branch, what takes it back) by a stack."""
    stack, branch, out = [], 0, {}
    for event, action in events:
        if action == "new":
            stack, branch = [], 0
        elif action == "assistant":
            out[event] = [2 * len(stack), branch, None]
            stack.append(event)
        elif action == "back" or (action == "retry" and stack):
            branch += 1
            if stack:
                out[stack.pop()][2] = event
    return {(e, *x) for e, x in out.items()}


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(12)
    rows = []
    for session in range(40):
        n = 900 if session == 3 else rng.randint(0, 40)  # one hot session
        weights = [3, 3, 3, 2, 2, 0 if session % 2 else 0.2]
        rows += [(session, 1_700_000_000 + k * 7 + session, session * 10_000 + k, rng.choices(ACTIONS, weights)[0]) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session long, at long, event_id long, action string").select("session", F.timestamp_seconds("at").alias("ts"), "event_id", "action")
    return rows, df.repartition(5)


@pytest.mark.parametrize("options", [{}, {"block_rows": 50}, {"block_seconds": 60}])
def test_pairs_and_what_takes_them_back(log, options):
    rows, df = log
    want = set()
    for session in {r[0] for r in rows}:
        want |= {(session, *x) for x in plain([(e, a) for _, _, e, a in sorted(r for r in rows if r[0] == session)])}
    got = rewound_turns(df, **options).collect()
    assert {(r["session"], r["event_id"], r["sequence_no"], r["branch"], r["undone_by"]) for r in got} == want and len(got) == len(want)


def test_blocked_numbering_still_equals_the_plain_one(log):
    _, df = log
    columns = ["session", "event_id", "sequence_no", "branch"]
    assert sorted(map(tuple, number_turns_blocked(df, block_rows=50).select(*columns).collect())) == sorted(map(tuple, number_turns(df).select(*columns).collect()))


def test_final_history_is_what_nothing_takes_back(spark):
    actions = ["user", "assistant", "user", "assistant", "back", "user", "assistant"]
    df = spark.createDataFrame([(1, 10 + k, k, a) for k, a in enumerate(actions)], "session long, at long, event_id long, action string").withColumn("ts", F.timestamp_seconds("at"))
    got = sorted(map(tuple, rewound_turns(df).collect()))
    assert got == [(1, 1, 0, 0, None), (1, 3, 2, 0, 4), (1, 6, 2, 1, None)]


def test_role_texts_with_a_new_input(spark):
    history = spark.createDataFrame([("c", 1, "user", "u1"), ("c", 2, "assistant", "a1"), ("c", 3, "user", "u2"), ("d", 1, "assistant", "b1")],
                                    "conversation_id string, pos int, role string, content string")
    asked = spark.createDataFrame([("c", "new"), ("e", "first")], "conversation_id string, content string")
    newest = set(map(tuple, split_by_role(history, "conversation_id", "pos", asked).collect()))
    assert newest == {("c", "user", 0, "new"), ("c", "user", 1, "u2"), ("c", "user", 2, "u1"), ("c", "assistant", 0, "a1"), ("d", "assistant", 0, "b1"), ("e", "user", 0, "first")}
    legacy = set(map(tuple, split_by_role(history, "conversation_id", "pos", asked, legacy_order=True).collect()))
    assert legacy == {("c", "user", 0, "u2"), ("c", "user", 1, "u1"), ("c", "user", 2, "new"), ("c", "assistant", 0, "a1"), ("d", "assistant", 0, "b1"), ("e", "user", 0, "first")}


def test_a_new_chat_begins_at_zero(spark):
    history = spark.createDataFrame([("c", "2024-01-01", 4, 1), ("c", "2024-01-02", 5, 0)], "conversation_id string, date string, sequence_no int, branch int")
    chats = spark.createDataFrame([("c",), ("n",)], "conversation_id string")
    assert set(map(tuple, resume_position(history, chats).collect())) == {("c", 6, 0), ("n", 0, 0)}
    assert set(map(tuple, resume_position(history).collect())) == {("c", 6, 0)}
