"""Vector codes against a plain restatement of the rounds."""

import math
from collections import Counter
from hashlib import sha256

from mnemo.llm.vector_codes import label_errors, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, key string, q int, position string, entry int, of int"


def plain(rows, rounds=2):
    """(vec_id, label, code, error) of every kept row, and the digest."""
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [max(-2 ** 27, min(2 ** 27, math.floor(256 * x))) for x in v]))
    start = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))[:64]
    d = len(start[0][2])
    kept = [r for r in kept if len(r[2]) == d]
    cuts = [p * d // 16 for p in range(17)]
    parts = [[r[2][a:b] for r in kept] for a, b in zip(cuts, cuts[1:])]
    books = [[r[2][a:b] for r in start if len(r[2]) == d] for a, b in zip(cuts, cuts[1:])]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(16):
            held = {}
            for x in parts[p]:
                held.setdefault(nearest(p, x)[1], []).append(x)
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, (vec, label, _) in enumerate(kept):
        best = [nearest(p, parts[p][i]) for p in range(16)]
        out.append((vec, label, "".join(f"{e:02x}" for _, e in best), sum(f for f, _ in best)))
    return out, sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "k", 1, "p", 2, 3) for i, v, label in rows], SCHEMA).repartition(3)


def check(spark, rows, **options):
    coded, books = vector_codes(frame(spark, rows), **options)
    want, digest = plain(rows, options.get("rounds", 2))
    got = label_errors(coded).collect()
    assert books.digest() == digest
    assert Counter((r["vec_id"], r["label"], r["code"], r["error"]) for r in got) == Counter(want)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def vectors(n, d=32, seed=5):
    out, x = [], seed
    for _ in range(n):
        row = []
        for _ in range(d):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2 ** 64
            row.append(((x >> 40) - 2 ** 23) / 2 ** 22)
        out.append(row)
    return out


def test_rounds_equal_a_plain_restatement(spark):
    rows = [(i * 3, v, i % 4 or None) for i, v in enumerate(vectors(300))]
    check(spark, rows)
    check(spark, rows, rounds=4, owner_rows=7)


def test_hot_vector_and_few_rows(spark):
    v = vectors(90)
    check(spark, [(i, v[i % 3 and 0 or i], 1) for i in range(90)], owner_rows=8)  # two thirds are one vector
    check(spark, [(i, v[i], 1) for i in range(5)])


def test_defined_results_on_odd_rows(spark):
    v = vectors(70, 16)
    nan, inf = float("nan"), float("inf")
    rows = [(i, x, None) for i, x in enumerate(v)]
    rows += [(None, v[0], 1), (3, v[9], 1), (3, v[9], 1), (100, None, 1), (101, [], 1), (102, [nan] * 16, 1), (103, [inf] + v[0][1:], 1),
             (104, [None] + v[0][1:], 1), (105, [1e30, -1e30] * 8, 2), (106, v[0][:8], 2)]
    check(spark, rows)
    check(spark, [(i, x[:10], 1) for i, x in enumerate(v)])  # parts as even as can be
    empty, books = vector_codes(frame(spark, rows).where("false"))
    assert books is None and label_errors(empty).collect() == [] and label_errors(empty).columns == ["vec_id", "label", "code", "error", "label_error"]


def test_only_parts_that_change_entry_migrate(spark):
    from mnemo.llm import vector_codes as m
    rows = [(i, v, 1) for i, v in enumerate(vectors(200))]
    kept = m.stage(m.kept_vectors(frame(spark, rows).selectExpr("vec_id AS id", "label", "embedding AS vector"), "vector")
                   .selectExpr("monotonically_increasing_id() AS key", "id", "q"), "t")
    books = m.Codebooks(m.np.array([r["q"] for r in kept.orderBy("id").limit(64).collect()], m.np.int64), 16)
    resident = m.stage(m.to_owners(m.assigned_parts(kept, books, 2), 200), "t")
    moved = m.reassigned(resident, books, 2).where("moved")
    assert moved.count() == 0
    later = m.updated(resident, books)

    def of(df):
        return {(r["position"], k): r["entry"] for r in df.collect() for k in m.np.frombuffer(r["keys"], m.np.int64).tolist()}

    before, after = of(resident), of(m.reassigned(resident, later, 2))
    gone = of(m.reassigned(resident, later, 2).where("moved"))
    assert len(before) == len(after) == 3200
    assert set(gone) == {k for k in before if before[k] != after[k]} and 0 < len(gone) < len(before)
