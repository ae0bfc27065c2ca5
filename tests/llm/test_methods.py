"""Parts of the operators against plain statements of what they compute, without Spark."""

import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from mnemo.llm.ann import Tree, nearest
from mnemo.llm.decontaminate import WindowSearch, joined, merged, words_of
from mnemo.llm.html_text import extract_text
from mnemo.llm.jaccard import Bands, bitmap, fold
from mnemo.llm import jaccard, langid, toxicity
from mnemo.llm.langid import Chain
from mnemo.llm.packing import make_plan, nnls, slot_ranges
from mnemo.llm.shingles import shingles
from mnemo.llm.shingles import words_of as shingle_words
from mnemo.llm.suffix_dedup import anchors, common_words
from mnemo.llm.toxicity import HIDDEN, WINDOW, Network, sigmoid, windows


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    bands = Bands(80)
    for size in [*range(1, 60), 90, 200, 257, 300, 700, 2500]:
        for _ in range(6):
            common = rng.integers(1, 1 << 63, size, dtype=np.uint64)
            # the largest differences that still link: c >= 0.8 (a + b - c)
            a = int(rng.integers(0, size // 4 + 1))
            b = size // 4 - a
            x = np.unique(np.concatenate([common, rng.integers(1, 1 << 63, a, dtype=np.uint64)]))
            y = np.unique(np.concatenate([common, rng.integers(1, 1 << 63, b, dtype=np.uint64)]))
            assert 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
            (sx, nx), (sy, ny) = bands.signatures(x), bands.signatures(y)
            assert len(np.intersect1d(sx, sy)) >= max(nx, ny)


def test_parity_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((5, 9), (100, 40), (700, 3000)):
        x, y = (np.unique(rng.integers(0, 5000, k).astype(np.uint64)) for k in (n, m))
        bx, by = bitmap(x), bitmap(y)
        size = min(len(bx), len(by))
        assert np.bitwise_count(fold(bx, size) ^ fold(by, size)).sum() <= len(np.setxor1d(x, y))


def test_shingles_are_the_distinct_windows():
    rng = random.Random(3)
    for n in (0, 1, 4, 5, 6, 300):
        words = [rng.choice("ab cd ef é ñ".split()) for _ in range(n)]
        want = {tuple(words[i:i + 5]) for i in range(max(1, n - 4))} if n else set()
        assert len(shingles(shingle_words("\n".join(words)))) == len(want)
    assert (shingles(shingle_words("A b\x0bC  d e")) == shingles(shingle_words("a B c D E"))).all()
    long = "x" * 1000
    assert len(shingles(shingle_words(f"{long} a b c d e {long} a b c d e"))) == 6


def test_window_search_finds_every_occurrence():
    rng = random.Random(4)
    letters = ["a", "bb", "ccc", "é"]
    for _ in range(60):
        items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 7)))) for i in range(6)]
        text = words_of(" ".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))))
        hit, found = set(), set()
        for item, t in items:
            w = words_of(t)
            n = min(3, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                for j in range(len(text) - n + 1):
                    if text[j:j + n] == w[i:i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item)
        spans, ids = WindowSearch(items, 3).hits(text)
        assert {k for a, b in spans for k in range(a, b)} == hit and ids == found
        assert sum(b - a for a, b in merged(spans)) == len(hit)
    assert joined([b"a"]) == b" a "


def test_plan_packs_every_piece_once():
    rng = np.random.default_rng(5)
    for histogram in ({}, {4096: 3}, {1: 10_000}, {4095: 5, 1: 2}, {n: int(rng.integers(1, 90)) for n in rng.integers(1, 4097, 900)},
                      {n: 7 for n in range(1500, 2600)}):
        plan = make_plan(dict(histogram))
        seen: dict[int, int] = {}
        for lengths, copies in zip(plan.lengths, plan.copies):
            assert sum(lengths) <= 4096
            for x in lengths:
                seen[x] = seen.get(x, 0) + copies
        assert {k: v for k, v in seen.items() if v} == histogram
        assert len(slot_ranges(plan)) <= 20 * 4096
    small = {n: 50 for n in range(20, 1200, 3)}
    assert sum(make_plan(small).copies) <= 1.01 * sum(k * v for k, v in small.items()) / 4096 + 1


def test_least_squares_stays_non_negative():
    rng = np.random.default_rng(6)
    a, x = rng.random((12, 7)), np.array([0, 2.0, 0, 1.0, 0, 0, 3.0])
    assert np.allclose(nnls(a, a @ x), x, atol=1e-6)
    assert (nnls(a, -np.ones(12)) == 0).all()


def test_anchors_are_near_the_start_of_every_shared_passage():
    rng = random.Random(7)
    words = [str(rng.randrange(500)).encode() for _ in range(400)]
    for k in range(0, 340, 7):
        passage = words[k:k + 50]
        other = [b"u%d" % rng.randrange(99) for _ in range(rng.randrange(1, 60))] + passage + [b"v"] * 30
        at = {int(i) - k for i in anchors(words, 26, 25, 4)[0] if k <= i < k + 25}
        there = {int(i) - other.index(passage[0]) for i in anchors(other, 26, 25, 4)[0]}
        assert at & there
    assert common_words("a b c ", "a b cd ") == 2 and common_words("a b ", "a b ") == 2 and common_words("x ", "y ") == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(8)
    chain = Chain(["x", "y", "z"])
    chain.trans, chain.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [1, 5, 200, 2, 64]
    scores = rng.normal(size=(sum(lengths), 3))
    first = np.zeros(len(scores), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, at = chain.posteriors(scores, first), 0
    for n in lengths:
        e, a = np.exp(scores[at:at + n]), np.exp(chain.trans)
        fore, back = [np.exp(chain.start) * e[0]], [np.ones(3)]
        for t in range(1, n):
            fore.append(fore[-1] @ a * e[t])
            fore[-1] /= fore[-1].sum()
        for t in range(n - 1, 0, -1):
            back.append(a @ (e[t] * back[-1]))
            back[-1] /= back[-1].sum()
        want = np.array(fore) * np.array(back[::-1])
        assert np.allclose(got[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def test_network_gradients():
    net, rng = Network(), np.random.default_rng(9)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    gates, mask, y = rng.normal(size=(3, WINDOW, 6 * HIDDEN)), np.ones((3, WINDOW)), np.array([0, 1, 1.0])
    mask[1, 11:] = 0
    g, d = net.gradients(gates, mask, y)

    def loss():
        p = sigmoid(net.run(gates, mask))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for table, grad, at in ((net.p["att"], g["att"], (3, 2)), (net.p["out"], g["out"], (5,)), (net.p["hf"], g["hf"], (2, 19)), (net.p["hb"], g["hb"], (1, 3)),
                            (gates, d, (0, 4, 20)), (gates, d, (2, 9, 40))):
        table[at] += 1e-4
        up = loss()
        table[at] -= 2e-4
        down = loss()
        table[at] += 1e-4
        assert grad[at] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_windows_cover_every_word():
    for n in range(1, 200):
        starts = windows(n)
        assert starts[0] == 0 and starts[-1] + WINDOW >= n and all(b - a < WINDOW for a, b in zip(starts, starts[1:]))


def test_tree_visits_every_leaf_and_blocks_are_exact():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(500, 6))
    x[100:400] = x[0]
    tree = Tree(x)
    assert sorted(tree.visits(x[3])) == list(range(tree.leaves))
    assert set(tree.assign(x)) <= set(range(tree.leaves))
    ids = rng.permutation(500)
    got = nearest(x[:5], ids[:5], x, ids, 10)
    for q in range(5):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((float(a), int(i)) for a, i in zip(d, ids) if i != ids[q])[:10]
        mine = [(s, i) for w, i, s in got if w == ids[q]]
        assert [i for _, i in mine] == [i for _, i in want] and [s for s, _ in mine] == pytest.approx([s for s, _ in want])


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav><div class="cookie-notice">We use cookies, a lot, really.</div>
<main><article><header><h1>The &amp; title</h1></header><p>First  paragraph,
with <b>bold</b>, <a href=x>a link</a> and a caf&eacute;.<p>Second<br>line &#8212; done, and more text to be long enough.
<ul><li>one<li>two</ul><form><input><button>Send</button></form><script>if (a < b) "</p>"</script>
<div class="share-buttons">Share this</div><table><tr><td>cell a<td>cell b</table></article></main>
<aside><p>Side text, side text, side text, side text, side text.</p></aside>
<section id="comments"><p>I, a reader, think, well, that this, and that, is wrong, very wrong indeed.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    assert extract_text(PAGE).split("\n") == ["The & title", "First paragraph, with bold, a link and a café.",
                                              "Second line — done, and more text to be long enough.", "one", "two", "cell a", "cell b"]


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<nav><a>x</a></nav>", ""),
    ("<div><div id=menu><a>a</a><a>b</a></div><div><p>Some text, here.</p><p>More of it.</p></div></div>", "Some text, here.\nMore of it."),
    ("<body><p>a<p>b</body>", "a\nb"), ("<article>x <!-- c --> y</article>", "x y"), ("<p>&lt;b&gt; &nbsp; z</p>", "<b> z"),
    ("<article><p>one</p></article><article class=comment><p>two, three</p></article>", "one"),
])
def test_main_text_cases(html, text):
    assert extract_text(html) == text


STORY = "<h1>Title</h1><p>The story, told in full, is long enough.</p><p>It goes on, and on, to its end.</p>"
TOLD = "Title\nThe story, told in full, is long enough.\nIt goes on, and on, to its end."


@pytest.mark.parametrize("page, text", [
    (f'<div class="content has-sidebar"><article>{STORY}</article></div>', TOLD),
    (f'<div id="page" class="with-sidebar"><div>{STORY}</div></div>', TOLD),
    (f'<div class="post no-comments">{STORY}</div>', TOLD), (f'<div class="postNoComments hasAds">{STORY}</div>', TOLD),
    (f'<article class="entry has-comments">{STORY}</article>', TOLD), (f'<div class="layout-without-ads">{STORY}</div>', TOLD),
    (f'<div class="wrapper search"><article>{STORY}</article></div>', TOLD),
    (f'<div class="sidebar-left"><div class="related"><main>{STORY}</main></div><div class="sidebar"><p>Aside, aside.</p></div></div>', TOLD),
    (f'<div class="widget"><div class="menu"><ul><li><a>Home</a><li><a>More</a></ul></div>{STORY}<div class="ads"><p>Buy, now.</p></div></div>', TOLD),
    (f'<main><div class="sidebar-right">{STORY}</div><div class="sidebar"><p>Aside, aside.</p></div></main>', TOLD),
    # what is marked and doesn't wrap the article stays out, however long
    (f'<div>{STORY}</div><div class="comments">{"<p>I, a reader, think, well, that this is wrong.</p>" * 9}</div>', TOLD),
    (f'<article>{STORY}</article><div class="comments">{"<article class=comment><p>I, a reader, think, well, no.</p></article>" * 9}</div>', TOLD),
    (f'<div>{STORY}</div><div class="related"><article><p>Another one, short.</p></article></div>', TOLD),
    (f'<div class="cookie-consent">{"<p>We use cookies, a lot, really, for you.</p>" * 9}</div><div>{STORY}</div>', TOLD),
])
def test_class_words_on_wrappers(page, text):
    assert extract_text(f"<html><body>{page}</body></html>") == text


LONG_PARTS = "".join(f"<p>Sentence {i}, with a comma, and another, and words to go on with for a while.</p>" for i in range(9))
LINKS = "<li><a>Reference one</a><li><a>Reference two</a><li><a>Reference three</a>"


def test_blocks_beside_and_around_the_best_container_stay():
    got = extract_text(f"<body><p>Far out.</p><div><div><section>{LONG_PARTS}</section><section><h2>Short</h2><p>One line.</p></section>"
                       f"</div><div>Further out.</div></div><ul>{LINKS}</ul></body>").split("\n")
    assert got[0] == "Far out." and got[1].startswith("Sentence 0") and got[9].startswith("Sentence 8") and got[10:] == ["Short", "One line.", "Further out."]


@pytest.mark.parametrize("outer", ["article", "main"])
def test_lists_of_links_in_an_article_stay(outer):
    got = extract_text(f"<ol>{LINKS}</ol><{outer}><p>First, of all.</p><p><a>One</a> <a>two</a> <a>three</a></p><p>Last, at the end.</p>"
                       f"<h2>References</h2><ol>{LINKS}</ol></{outer}>").split("\n")
    assert got == ["First, of all.", "One two three", "Last, at the end.", "References", "Reference one", "Reference two", "Reference three"]


def test_lists_of_links_between_paragraphs_stay():
    got = extract_text(f"<div><ul>{LINKS}</ul>{LONG_PARTS}<ul>{LINKS}</ul><p>The end, at last.</p><ul>{LINKS}</ul></div>").split("\n")
    assert len(got) == 9 + 3 + 1 and got[9:] == ["Reference one", "Reference two", "Reference three", "The end, at last."]


def test_words_are_whole_and_bounded():
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 900))) + "x" * 301 + "é" * 77 + "ก" * 500
    parts = langid.words_of(text)
    assert b"".join(parts).decode() == text and max(map(len, parts)) <= 64 and [p.decode() for p in parts]
    assert langid.words_of("Eins\u00a0zwei\u3000drei。vier、fünf “sechs” sieben—acht") == [w.encode() for w in "eins zwei drei vier fünf sechs sieben acht".split()]
    assert langid.words_of("a" * 64) == [b"a" * 64] and langid.words_of(" 12 \u2003 。") == []


@pytest.mark.parametrize("space", ["", "\u00a0", "\u3000", "。"])
def test_the_middle_of_a_text_without_ascii_spaces_counts(space):
    rng = random.Random(21)
    clean, bad = ([chr(at + rng.randrange(60)) + chr(at + rng.randrange(60)) + chr(at + rng.randrange(60)) for _ in range(40)] for at in (0x4E00, 0x6000))

    def text(n, toxic=0):
        words = [rng.choice(clean) for _ in range(n)]
        words[n // 2:n // 2] = [rng.choice(bad) for _ in range(toxic)]
        return space.join(words)

    net = toxicity.fit([(text(30, 8 * y), y) for y in (0, 1) for _ in range(60)], steps=60)
    memo = toxicity.WordRows(net.gates, 6 * HIDDEN)
    low = toxicity.text_logits(net, memo, [langid.words_of(text(400)) for _ in range(20)])
    high = toxicity.text_logits(net, memo, [langid.words_of(text(400, 12)) for _ in range(20)])
    assert np.mean(low[:, None] < high[None]) > 0.9

    chain = langid.fit([(text(30, 30 * y), "xy"[y]) for y in (0, 1) for _ in range(40)], steps=60)
    label = langid.label(chain, langid.WordRows(chain.emissions, 2), [space.join([rng.choice(clean) for _ in range(30)] + [rng.choice(bad) for _ in range(500)] + [rng.choice(clean) for _ in range(30)])])
    assert label[0][0] == "y"


def test_memory_is_given_back():
    script = """
import re
import numpy as np, pyarrow as pa
from mnemo.llm.common import resident
from mnemo.llm.wordrows import WordRows

def held():
    return int(re.search(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def memo():
    parts = [pa.array([b"%064d" % i for i in range(j, j + 20_000)]) for j in range(0, 1_000_000, 20_000)]
    return len(pa.concat_arrays(parts))

rows = WordRows(lambda words: np.ones((len(words), 48), np.float32), 48)
start = held()
rows.rows([b"%d" % i for i in range(135_000)])
table = held() - start
del rows
start = held()
resident("first", memo)
full = held() - start
resident("second", dict)
print(table, full, held() - start)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, check=True)
    table, full, left = map(float, done.stdout.split())
    assert table < 90  # 135,000 rows of 192 bytes and the words; not the 262,144 rows that there is room for, twice
    assert left < full / 2


def test_texts_go_to_workers_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3_000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 500) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"size": [int(b["text"].str.len().sum())]})

    def largest():
        return docs.mapInPandas(sizes, "size long").groupBy().max("size").first()[0]

    before = spark.conf.get(setting, None)
    try:
        spark.conf.unset(setting)
        assert largest() > 12_000_000
        jaccard.jaccard_components(docs.limit(5)).collect()
        assert largest() < 4_500_000
        spark.conf.set(setting, "1000000")  # what the session says stays
        jaccard.jaccard_components(docs.limit(5)).collect()
        assert spark.conf.get(setting) == "1000000"
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def test_a_task_gives_back_what_it_held():
    script = """
import re
import numpy as np, pandas as pd, pyarrow as pa
from mnemo.llm import jaccard

def held():
    return int(re.search(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

class Rows:
    def mapInPandas(self, run, schema):
        return run

def batches():
    for i in range(0, 6_000, 500):
        texts = [" ".join(f"{d * 7919 % 6007}w{k}" for k in range(400)) for d in range(i, i + 500)]
        yield pa.RecordBatch.from_pydict({"doc": range(i, i + 500), "text": texts}).to_pandas()

run, start = jaccard.sign_texts(Rows(), 5, 80, 64), held()
for b in run(batches()):
    pa.RecordBatch.from_pandas(b)
del b
print(held() - start)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 40
