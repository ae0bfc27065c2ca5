"""Spelling variants against a comparison of all pairs of words."""

import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from mnemo.llm import variants
from mnemo.llm.variants import document_variants, partition_pairs, spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain(words):
    form, out = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = len(around)
    rows = []
    for w, n in words.items():
        end = w
        while form[end] is not None:
            end = form[end]
        rows.append((w, form[w], end, n, out[w], words[form[w]] if form[w] is not None else None))
    return Counter(rows)


def plain_words(docs, least=2):
    n = Counter()
    for i, t in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({b: b + 32 for b in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= least}


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def random_words(rng, alphabet, n, lengths):
    return {"".join(rng.choice(list(alphabet), int(rng.integers(*lengths)))): int(10 ** rng.integers(0, 5)) for _ in range(n)}


@pytest.mark.parametrize("most", [20_000, 12])
def test_all_pairs(spark, most):
    rng = np.random.default_rng(11)
    words = random_words(rng, "ab", 300, (7, 11)) | random_words(rng, "aéÿ×", 200, (7, 10))
    words |= {"commonhead" + w: n for w, n in random_words(rng, "abc", 250, (3, 6)).items()}  # a third of all share their beginning
    words |= {w + "commontail": n for w, n in random_words(rng, "xyz", 60, (2, 4)).items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert got(spelling_variants(df, partition_words=most)) == plain(words)


def test_chains_and_ties(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaaabbbb": 1000, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50}
    rows = {r["word"]: r for r in spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert rows["aaaaaaa"]["form"] == "aaaaaab" and rows["aaaaaaa"]["root"] == "aaaabbb"
    assert rows["zzzzzzz"]["form"] == "zzzzzzx" and rows["zzzzzzx"]["root"] == "zzzzzzx" and rows["zzzzzzx"]["form"] is None


def test_documents(spark):
    long = "l" + "o" * 3_000 + "ng"
    docs = [(None, "without identity identity"), (1, None), (2, ""), (3, "123 !?"), (4, f"{long} {long} {long}x {long}x {long[:-1]} {long[:-1]}"),
            (5, "Straße STRASSE straßen Straßen-straße naïveté naïvete naïvete NAÏVETÉ ÀÿÀÿÀÿÀ ÀÿÀÿÀÿÀ ÷÷×××÷÷ ÷÷×××÷÷"), (5, "identity identities"), (5, "identity identities")]
    docs += [(i, "recurring reccurring sentences sentence sentense occasionally occasionaly") for i in range(100, 400)]
    df = spark.createDataFrame([(i, t, "w", 1, 2, "r") for i, t in docs], "doc_id long, text string, word string, n int, id int, run string")
    want = plain_words(docs)
    assert any(len(w) > 3_000 for w in want) and len(want) > 20
    assert got(document_variants(df)) == plain(want)
    assert document_variants(df.where("false")).collect() == []


def test_partition_pairs_are_found_once():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = int(rng.integers(1, 6))
        mids = sorted({"".join(rng.choice(list("abc"), size + int(rng.integers(0, 2)))) for _ in range(12)}, key=lambda _: rng.random())
        for at_end in (False, True):
            pairs = [tuple(sorted((mids[a], mids[b]))) for a, b in partition_pairs(size, mids, at_end)]
            want = {tuple(sorted((u, v))) for u in mids for v in mids if len(u) == size and near(u, v)
                    and (at_end or len(u) == len(v) or not v.startswith(u))}
            assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_minimised_acceptor():
    words = sorted(a + b + c for a in "abcdef" for b in "xyz" for c in ("ing", "ers"))
    m = variants.Acceptors()
    start = m.accept(words)
    assert m.count[start] == len(words) and len(m.arcs) == 1 + 4 + 1 + 1 + 1  # end; g, ng, s, rs; ing or ers; a letter b; the start
    assert m.accept(words) == start
