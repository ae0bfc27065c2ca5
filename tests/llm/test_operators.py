"""The operators on Spark: edge cases of every input, and brute force where SQL can't tell."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mnemo.llm import jaccard, queries, suffix_dedup
from mnemo.llm.ann import search
from mnemo.llm.common import stage
from mnemo.llm.decontaminate import decontaminate
from mnemo.llm.html_text import extract
from mnemo.llm.jaccard import jaccard_components
from mnemo.llm.langid import identify
from mnemo.llm.line_dedup import line_dedup
from mnemo.llm.packing import pack
from mnemo.llm.suffix_dedup import repeated_passages
from mnemo.llm.tokens import token_counts
from mnemo.llm.toxicity import toxicity

from ..conftest import SF_CHECK, SF_SMALL

BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
# extra columns carry names that the operators use inside
EDGES = [(None, "null id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a b c\nd e f\ng h i"), (6, "123 !?"), (7, LONG), (8, LONG), (2 ** 60 + 1, "big id é ñ")]
CLASH = "doc_id long, text string, id string, doc int, n_words string, score string, rest int, hash int, body string, list int, part int, key string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2, 3, "b", 4, 5, "k") for i, t in EDGES], CLASH)


@pytest.fixture(scope="module")
def none(edges):
    return edges.where("false")


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in rows(df)}


def test_token_counts(spark, edges, none):
    got = rows(token_counts(edges, BPE))
    tok = Tokenizer.from_file(BPE)
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGES)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts(none, BPE).count() == 0
    odd = ["a<|endoftext|>b <|startoftext|>", "ΑΣ Σ'S don't I'LL 12345 !!!", "é é ́x\x1cz\x85w", "İstanbul ǅ ﬁ 中文字 🙂", "ªº² \xa0x\xad ß ſ"]
    odd = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    texts = [r["text"] for r in odd.orderBy("doc_id").collect()]
    assert [by_id(token_counts(odd, BPE))[i]["n_tokens"] for i in range(5)] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = queries.table(spark, SF_SMALL, "documents")
    want = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows(queries.op10_token_counts(spark, SF_SMALL))} == want


def check_packing(docs, got, capacity):
    tok = Tokenizer.from_file(BPE)
    want = Counter()
    for r in docs:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            x = np.array(ids[k:k + capacity], "<u4")
            want[r["doc_id"], k // capacity, k, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing(spark, edges, none):
    check_packing(edges.collect(), rows(pack(edges, BPE)), 4096)
    assert pack(none, BPE).count() == 0
    docs = queries.table(spark, SF_CHECK, "documents").collect()
    got = rows(queries.op2_packing(spark, SF_CHECK))
    assert check_packing(docs, got, 4096) <= 1.01 * sum(r["length"] for r in got) / 4096 + 1


def test_line_dedup_edges(spark, edges, none):
    got = rows(line_dedup(edges, keep=["hash", "rest", "body"]))
    assert len(got) == len(EDGES) and all(r["hash"] == 3 and r["rest"] == 2 and r["body"] == "b" for r in got)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(EDGES)
    assert {r["n_lines"] for r in got if r["doc_id"] == 1} == {0} and {r["n_lines"] for r in got if r["doc_id"] == 2} == {1}
    assert line_dedup(none).count() == 0
    lines = [f"line number {i} says {i * i}" for i in range(40)]
    a, b = "\n".join(lines), "\n".join(["new head", *lines, "new tail"])
    made = spark.createDataFrame([(9, b), (3, a), (3, a), (5, "\n".join(["same", "same"] * 4))], "doc_id long, text string")
    got = rows(line_dedup(made))
    assert [r["text"] for r in got if r["doc_id"] == 3] == [a, a]
    late = next(r for r in got if r["doc_id"] == 9)
    assert late["n_removed"] >= 30 and late["text"].startswith("new head") and late["text"].endswith("new tail")


def test_decontaminate_edges_and_blocks(spark, edges, none):
    bench = spark.createDataFrame([(1, "ONE"), (2, None), (None, "one"), (3, ""), (4, "b! c, d"), (4, "b! c, d"), (10, "big id")], "item_id long, text string")
    got = rows(decontaminate(edges, bench, n=2, keep=["n_words"][:0] or ["score"]))
    found = {(r["doc_id"], tuple(r["items"]), r["n_hit"]) for r in got if r["contaminated"]}
    assert found == {(4, ("1",), 1), (5, ("4",), 3), (2 ** 60 + 1, ("10",), 2)} and all(r["score"] == "z" for r in got) and len(got) == len(EDGES)
    assert decontaminate(none, bench).count() == 0 and not any(r["contaminated"] for r in rows(decontaminate(edges, bench.where("false"))))
    docs, bench = (queries.table(spark, SF_SMALL, t) for t in ("documents", "benchmark"))
    assert sorted(map(str, rows(decontaminate(docs, bench)))) == sorted(map(str, rows(decontaminate(docs, bench, block_bytes=2_000))))


def brute_passages(docs, n):
    """id -> words inside an n-word passage that occurs at two places."""
    where = {}
    for k, (doc, text) in enumerate(docs):
        w = text.split()
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i:i + n]), []).append((k, doc, i))
    out = {}
    for spots in where.values():
        if len(spots) > 1:
            for _, doc, i in spots:
                out.setdefault(doc, set()).update(range(i, i + n))
    return out


def test_repeated_passages(spark, edges, none):
    got = {r["doc_id"]: r for r in rows(repeated_passages(edges))}
    assert set(got) == {7, 8} and got[7]["starts"] == [0] and got[8]["ends"] == [30_000]
    assert repeated_passages(none).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF_CHECK, "documents").collect() if r["text"]]
    ascii_only = [(i, t) for i, t in docs if not set(t) - set(map(chr, range(9, 127)))] + [(-1, " ".join(docs[0][1].split()[:49])), (-2, "x " * 300)]
    got = {r["doc_id"]: {k for a, b in zip(r["starts"], r["ends"]) for k in range(a, b)}
           for r in rows(repeated_passages(spark.createDataFrame(ascii_only, "doc_id long, text string")))}
    full, part = brute_passages(ascii_only, 50), brute_passages(ascii_only, 26)
    assert len(full) > 5
    for doc, words in full.items():
        assert words <= got.get(doc, set())
    for doc, words in got.items():
        assert words <= part[doc]


def test_html_edges(spark):
    pages = spark.createDataFrame([(None, "u", "<p>a</p>", 1), (1, None, None, 1), (2 ** 60 + 1, "v", "", 1), (3, "w", "<p>x &amp; y</p>", 1)], "page_id long, url string, html string, id int")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in rows(extract(pages))}
    assert got == {None: ("u", "a", 1), 1: (None, "", 0), 2 ** 60 + 1: ("v", "", 0), 3: ("w", "x & y", 5)}
    assert extract(pages.where("false")).count() == 0


def brute_components(docs, percent=80):
    sets = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        sets.setdefault(doc, []).append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_jaccard_edges(edges, none):
    got = rows(jaccard_components(edges))
    assert len(got) == len(EDGES)
    assert {r["doc_id"]: r["component_id"] for r in got} == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 2 ** 60 + 1: 2 ** 60 + 1}
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (None, 1, 2, 3, 4)} == {None: 1, 1: 0, 2: 0, 3: 0, 4: 1}
    assert jaccard_components(none).count() == 0


@pytest.mark.parametrize("small_blocks", [False, True])
def test_jaccard_groups(spark, monkeypatch, small_blocks):
    if small_blocks:  # lists and representatives are split over tasks
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
        monkeypatch.setattr(jaccard, "PAIRS_PER_TASK", 3)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rng = np.random.default_rng(12)
    docs, vocabulary = [], [f"v{i}" for i in range(4000)]
    for group in range(6):  # chains of edits: neighbours link, ends don't
        words = list(rng.choice(vocabulary, 120))
        for _ in range(25):
            docs.append((int(rng.integers(1, 1 << 40)), " ".join(words)))
            for _ in range(int(rng.integers(0, 4))):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
    passage = " ".join(rng.choice(vocabulary, 60))  # one passage in texts that are otherwise unlike
    docs += [(int(rng.integers(1, 1 << 40)), " ".join([*rng.choice(vocabulary, 30), passage, *rng.choice(vocabulary, 30)])) for _ in range(60)]
    docs += [(int(rng.integers(1, 1 << 40)), " ".join(rng.choice(vocabulary[:3], int(n)))) for n in rng.integers(1, 12, 60)]
    docs += docs[:10]
    got = rows(jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)))
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(docs) and len(got) == len(docs)


def test_language(spark, edges, none):
    odd = edges.withColumn("lang", F.when(F.col("doc_id") < 5, F.lit("xx")).otherwise(F.lit("yy")))
    got = rows(identify(odd))
    assert len(got) == len(EDGES) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 6))
    assert identify(odd.where("false")).count() == 0
    assert {r["lang_pred"] for r in rows(identify(edges.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}
    lang = {r["doc_id"]: r["lang"] for r in queries.table(spark, SF_CHECK, "documents").select("doc_id", "lang").collect()}
    got = [r for r in rows(queries.op7_language_id(spark, SF_CHECK)) if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["lang_pred"] != "und" and lang[r["doc_id"]]]) > 0.97


def test_toxicity(spark, edges, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = rows(toxicity(edges, labels, keep=["score", "rest"][1:]))
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 and r["rest"] == 2 for r in got)
    assert toxicity(none, labels).count() == 0 and {r["score"] for r in rows(toxicity(edges, labels.where("false")))} == {0.0}
    truth = {r["doc_id"]: r["toxic"] for r in queries.table(spark, SF_CHECK, "labels").collect()}
    got = [r for r in rows(queries.op8_toxicity(spark, SF_CHECK)) if r["held_out"] and truth.get(r["doc_id"]) is not None]
    low, high = ([r["score"] for r in got if truth[r["doc_id"]] == y] for y in (0, 1))
    assert np.mean([a < b for a in low for b in high]) > 0.85
    assert np.mean([x >= 0.7 for x in low]) < 0.05


def test_nearest(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(700, 8)).astype("float32")
    x[200:450] = x[100]
    data = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 8, 1, 2), (10_000, None, 1, 2), (10_100, [0.0] * 8, 1, 2), (10_200, [float("nan")] * 8, 1, 2), (10_300, [1.0, None] + [1.0] * 6, 1, 2), (10_400, [1.0], 1, 2)]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, id int, leaf int")
    got = rows(search(vectors))
    assert {r["query_id"] for r in got} == set(range(0, 700, 100))
    right = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((float(a), i) for i, a in enumerate(d) if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in mine)
        right += len({i for _, i in want} & {i for _, i, _ in mine})
    assert right >= 0.9 * 70
    assert search(vectors.where("false")).count() == 0 and len(rows(search(vectors.where("vec_id IN (0, 1, 2)")))) == 2


def test_nearest_recall(spark):
    v = [(r["vec_id"], np.array(r["embedding"], float)) for r in queries.table(spark, SF_CHECK, "embeddings").collect() if r["embedding"] is not None]
    v = [(i, x) for i, x in v if np.isfinite(x).all() and x.any()]
    ids, x = np.array([i for i, _ in v]), np.stack([x for _, x in v])
    got, right = rows(queries.op9_nearest(spark, SF_CHECK)), 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = {i for _, i in sorted((a, i) for a, i in zip(d, ids) if i != q)[:10]}
        right += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
    assert right >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_pipeline_stages_against_brute_force(spark):
    docs, sf = queries.table(spark, SF_SMALL, "documents"), SF_SMALL
    steps = dict(corpus_pipeline.STAGES)
    clean = stage(steps["toxicity"](spark, docs, sf), "t")
    scores = {r["doc_id"]: r["predicted"] for r in rows(queries.op8_toxicity(spark, sf))}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, p in scores.items() if not p} and clean.columns == docs.columns

    con = duckdb.connect()
    con.register("documents", clean.toPandas())
    lines = stage(steps["line_dedup"](spark, clean, sf), "t")
    want = con.sql(queries.LINE_DEDUP_SQL).fetchall()
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {r[0]: r[1] for r in want} and lines.columns == docs.columns

    kept = stage(steps["jaccard_join"](spark, lines, sf), "t")
    comp = brute_components([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()))

    pure = stage(steps["decontamination"](spark, kept, sf), "t")
    con.register("documents", kept.toPandas())
    con.register("benchmark", queries.table(spark, sf, "benchmark").toPandas())
    bad = {r[0] for r in con.sql(queries.DECONTAMINATE_SQL.replace("SELECT doc_id, len(ws)::BIGINT", "SELECT doc_id, contaminated FROM (SELECT doc_id, len(ws)::BIGINT") + ") WHERE contaminated").fetchall()}
    assert {r["doc_id"] for r in pure.collect()} == {r["doc_id"] for r in kept.collect()} - bad

    check_packing(pure.collect(), rows(steps["packing"](spark, pure, sf)), 4096)
    assert corpus_pipeline.run(spark, sf).count() == steps["packing"](spark, pure, sf).count()


def test_language_labels_without_words_and_long_texts(spark):
    rng = np.random.default_rng(31)
    words = {"xx": [f"ka{c}o" for c in "bdfglmnprst"], "yy": [f"we{c}isch" for c in "bdfglmnprst"], "zz": [f"zu{c}ai" for c in "bdfglmnprst"]}

    def text(lang, n):
        return " ".join(rng.choice(words[lang], n))

    docs = [(i, text(lang, 30), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    docs += [(i, t, "aa") for i, t in zip(range(200, 230), ["", "123 !?", "\u3002 \u2014"] * 10)]  # one label whose rows have no word
    docs += [(i, "123 " * 20_000 + text("zz", 20_000), "zz") for i in range(300, 312)]  # one whose texts are all long
    docs += [(i, "?", "xx") for i in range(400, 1200)]  # texts without a word don't take the places of others
    got = by_id(identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), fit_docs=12))
    for i, t, lang in docs:
        want = lang if any(map(str.isalpha, t)) else "und"
        assert got[i]["lang_pred"] == want and (got[i]["score"] > 0.9) == (want != "und"), (i, lang, got[i])


def test_contexts_are_made_once_and_equal_ones_are_dealt_out(spark, monkeypatch):
    """A range exchange runs all that stands below it twice; ranges chosen beforehand cut a group of equal contexts by document."""
    staged = {}

    def kept(df, name):
        staged[name] = df
        return stage(df, name)

    monkeypatch.setattr(suffix_dedup, "stage", kept)
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(120))
    docs = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string")
    got = suffix_dedup.repeated_passages(docs).collect()
    assert len(got) == 200 and {(r["starts"][0], r["ends"][0], r["n_words"]) for r in got} == {(0, 120, 120)}
    assert "rangepartitioning" not in staged["neighbours"]._jdf.queryExecution().toString().lower()
    borders = staged["neighbours"].where("key IS NOT NULL").collect()
    assert len({r["part"] for r in borders}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
