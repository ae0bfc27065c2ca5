"""MinHash near-duplicates against all pairs of full sets."""

import numpy as np
import pytest

from mnemo.llm import jaccard, minhash
from mnemo.llm.minhash import SubKeys, near_duplicates
from mnemo.llm.shingles import shingles, words_of


def plain(docs, n=3, percent=85):
    """(component of every id) by comparing the sets of word tuples of all pairs of texts."""
    sets = []
    for i, t in docs:
        w = (t or "").translate({b: b + 32 for b in range(65, 91)}).encode().split()
        sets.append((i, {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    root = {i: i for i, _ in docs if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in root}


EDGES = [(None, "null id here"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"),
         (8, "a b c d"), (9, "a b c d"), (9, "x y z u v"), (10, "x y z u v"), (2 ** 60 + 1, "big id é ñ"),
         (11, " ".join(f"w{i % 977}x{i}" for i in range(30_000))), (12, " ".join(f"w{i % 977}x{i}" for i in range(29_900)))]


def test_edges(spark):
    df = spark.createDataFrame([(i, t, "k", 1, 2, "s", 3, 4) for i, t in EDGES], "doc_id long, text string, key string, doc int, n int, subs string, list int, rep int")
    got = near_duplicates(df).collect()
    assert len(got) == len(EDGES)
    assert {r["doc_id"]: r["component_id"] for r in got} == plain(EDGES) | {None: None}
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (1, 3, 5, 8, 11)} == {1: 0, 3: 0, 5: 1, 8: 2, 11: 29_998}
    assert near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("small_blocks", [False, True])
def test_groups_and_chains(spark, monkeypatch, small_blocks):
    if small_blocks:  # lists and representatives are split over tasks
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
        monkeypatch.setattr(jaccard, "PAIRS_PER_TASK", 3)
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rng = np.random.default_rng(7)
    docs, vocabulary = [], [f"v{i}" for i in range(4000)]
    for _ in range(6):  # chains of edits: neighbours link, ends don't
        words = list(rng.choice(vocabulary, 120))
        for _ in range(25):
            docs.append((int(rng.integers(1, 1 << 40)), " ".join(words)))
            for _ in range(int(rng.integers(0, 4))):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
    passage = " ".join(rng.choice(vocabulary, 60))  # one passage in texts that are otherwise unlike
    docs += [(int(rng.integers(1, 1 << 40)), " ".join([*rng.choice(vocabulary, 30), passage, *rng.choice(vocabulary, 30)])) for _ in range(60)]
    docs += [(int(rng.integers(1, 1 << 40)), " ".join(rng.choice(vocabulary[:3], int(n)))) for n in rng.integers(1, 12, 60)]
    docs += docs[:10]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain(docs) and len(got) == len(docs)


def test_sub_keys_agree_as_often_as_minima_do():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    same = []
    for _ in range(150):
        other = np.unique(np.concatenate([base[rng.permutation(400)[:360]], rng.integers(0, 1 << 62, 40).astype(np.uint64)]))
        a, b = SubKeys().of([base, other])
        same.append((a == b).mean())
        assert (a[:16] == b[:16]).any() and (a[16:] == b[16:]).any()
    assert abs(np.mean(same) - (360 / 440) ** 3) < 0.03
    x = shingles(words_of("a b c d e"), 3)
    assert (SubKeys().of([x, x[:1], x])[0] == SubKeys().of([x])[0]).all()
