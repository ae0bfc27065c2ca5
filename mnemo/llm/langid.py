"""Language identification by a linear-chain conditional random field over words.

Every word has affix, n-gram and lexicon features (hashed); transitions between
the languages of neighbouring words are learned with them.  Training sequences
are put together from pieces of several documents, so the transitions see
switches.  A text's words are labelled by exact forward-backward; the language
with the largest mean posterior is the text's.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import held_out, resident, slices
from mnemo.llm.wordrows import WordRows, gram_ids

#: Documents a language that the model is fitted on at most; of a text of more bytes, it reads a piece of at most so many.
FIT_DOCS = 600
FIT_BYTES = 1 << 16
BUCKETS = 1 << 17
STEPS = 500
SEQUENCE, BATCH = 48, 48
BLOCK = 64

# letters lower-cased, bytes from 128 on kept, all else a space
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: White space and punctuation beyond ASCII.
BREAK_CHARS = frozenset(c for c in map(chr, range(128, 0x20000)) if c.isspace() or unicodedata.category(c)[0] in "PZ")
BREAKS = re.compile(f"[{''.join(sorted(BREAK_CHARS))}]+")
#: Words of more bytes (text of a script without spaces, mostly) are read in consecutive pieces of at most so many.
LONG, PIECE = 64, 32


def words_of(text: str) -> list[bytes]:
    """The words of a whole text, lower-cased; long ones in pieces, which end between characters."""
    if not text.isascii() and not BREAK_CHARS.isdisjoint(set(text)):
        text = BREAKS.sub(" ", text)
    words = text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [p for w in words for p in (pieces(w) if len(w) > LONG else (w,))]


def pieces(word: bytes) -> Iterator[bytes]:
    a = 0
    while a < len(word):
        z = min(a + PIECE, len(word))
        while z < len(word) and word[z] & 0xC0 == 0x80:
            z -= 1
        yield word[a:z]
        a = z


def features(word: bytes) -> list[int]:
    """The word itself (lexicon), its affixes up to 4 bytes, its 2- and 3-grams."""
    ids = gram_ids(word, (2, 3), BUCKETS)
    ids += gram_ids(b"=" + word, (len(word) + 3,), BUCKETS)
    for n in range(1, 5):
        ids += gram_ids(b"<" + word[:n], (min(n, len(word)) + 3,), BUCKETS) + gram_ids(b">" + word[-n:], (min(n, len(word)) + 3,), BUCKETS)
    return ids


class Chain:
    """Weights of the field: emissions by feature, transitions, start."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs, self.emit = langs, np.zeros((BUCKETS, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        ids = [features(w) for w in words]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids])[:-1]))
        return np.add.reduceat(self.emit[np.concatenate(ids)], cuts, axis=0) if words else np.zeros((0, len(self.langs)))

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(language) of every word of several texts in a row; ``first`` marks where texts begin.

        Blocks of words are reduced to transfer matrices side by side, the matrices are
        chained, and forward and backward vectors are then filled in side by side again.
        """
        n, k = scores.shape
        blocks = -(-n // BLOCK)
        e = np.ones((blocks * BLOCK, k))
        e[:n] = np.exp(scores - scores.max(1, keepdims=True))
        begin = np.ones(blocks * BLOCK, bool)
        begin[:n] = first
        e, begin = e.reshape(blocks, BLOCK, k), begin.reshape(blocks, BLOCK)
        a, s = np.exp(self.trans - self.trans.max()), np.exp(self.start - self.start.max())

        def unit(v: np.ndarray) -> np.ndarray:
            return v / v.sum(-1, keepdims=True)

        whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in range(BLOCK):
            at = begin[:, t, None, None]
            whole = np.where(at, whole.sum(2, keepdims=True) * s, whole @ a) * e[:, t, None, :]
            whole /= whole.sum((1, 2), keepdims=True)
        enter, leave = np.empty((blocks, k)), np.empty((blocks, k))
        v = np.ones(k) / k
        for b in range(blocks):
            enter[b] = v
            v = v @ whole[b]
            v /= v.sum()
        v = np.ones(k) / k
        for b in range(blocks - 1, -1, -1):
            leave[b] = v
            v = whole[b] @ v
            v /= v.sum()
        out = np.empty((blocks, BLOCK, k))
        v = enter
        for t in range(BLOCK):
            v = unit(np.where(begin[:, t, None], s, v @ a) * e[:, t])
            out[:, t] = v
        v = leave
        for t in range(BLOCK - 1, -1, -1):
            out[:, t] *= v
            v = unit(np.where(begin[:, t, None], 1.0, (e[:, t] * v) @ a.T))
        return unit(out.reshape(-1, k)[:n])


def fit(texts: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Chain:
    """Maximum likelihood by Adam on sequences put together from pieces of the texts, (text, language).
    Languages without a word are not among the model's."""
    found: dict[str, list[list[bytes]]] = {}
    for t, y in texts:
        if any(map(str.isalpha, t)) and (w := words_of(t)):
            found.setdefault(y, []).append(w)
    langs = sorted(found)
    model, rng = Chain(langs), np.random.default_rng(seed)
    by = [found[lang] for lang in langs]
    k = len(langs)
    if k < 2:
        return model
    memo: dict[bytes, np.ndarray] = {}
    state = [[np.zeros_like(p, dtype=np.float64) for _ in range(2)] for p in (model.emit, model.trans, model.start)]
    for step in range(1, steps + 1):
        words, gold = [], np.zeros((BATCH, SEQUENCE), np.int64)
        for b in range(BATCH):
            at = 0
            while at < SEQUENCE:
                y = int(rng.integers(k))
                doc = by[y][rng.integers(len(by[y]))]
                i = int(rng.integers(max(1, len(doc) - 8)))
                piece = doc[i:i + min(SEQUENCE - at, int(rng.integers(4, 33)))]
                words += piece
                gold[b, at:at + len(piece)] = y
                at += len(piece)
        for w in words:
            if w not in memo:
                memo[w] = np.array(features(w))
        ids = [memo[w] for w in words]
        flat, sizes = np.concatenate(ids), np.array([len(x) for x in ids])
        cuts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        scores = np.add.reduceat(model.emit[flat].astype(float), cuts, axis=0).reshape(BATCH, SEQUENCE, k)
        e, a, s = np.exp(scores - scores.max(2, keepdims=True)), np.exp(model.trans), np.exp(model.start)
        fore, back = np.empty_like(e), np.ones_like(e)
        for t in range(SEQUENCE):
            v = (s if t == 0 else fore[:, t - 1] @ a) * e[:, t]
            fore[:, t] = v / v.sum(1, keepdims=True)
        for t in range(SEQUENCE - 2, -1, -1):
            v = (e[:, t + 1] * back[:, t + 1]) @ a.T
            back[:, t] = v / v.sum(1, keepdims=True)
        post = fore * back
        post /= post.sum(2, keepdims=True)
        hot = np.eye(k)[gold]
        d = post - hot
        pair = fore[:, :-1, :, None] * a * (e[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        g_emit = np.stack([np.bincount(flat, np.repeat(d.reshape(-1, k)[:, j], sizes), BUCKETS) for j in range(k)], 1) / BATCH + 1e-4 * model.emit
        g_trans = (pair - hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum((0, 1)) / BATCH
        for p, g, (m, v) in zip((model.emit, model.trans, model.start), (g_emit, g_trans, d[:, 0].sum(0) / BATCH), state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= (0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(p.dtype)
    return model


def label(chain: Chain, memo: WordRows, texts: list[str | None]) -> dict[int, tuple[str, float]]:
    """Index -> language and mean posterior, of the texts with a letter."""
    words = {i: w for i, t in enumerate(texts) if t and (w := words_of(t)) and any(map(str.isalpha, t))}
    if not words:
        return {}
    at = memo.rows([w for ws in words.values() for w in ws])
    size = np.array([len(ws) for ws in words.values()])
    starts = np.cumsum(size) - size
    first = np.zeros(len(at), bool)
    first[starts] = True
    mean = np.add.reduceat(chain.posteriors(memo.table[at].astype(float), first), starts, axis=0) / size[:, None]
    return {i: (chain.langs[int(m.argmax())], float(min(1.0, m.max()))) for i, m in zip(words, mean)}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """The language of every whole text: id, ``held_out``, ``lang_pred``, ``score`` (mean posterior, 0 to 1).

    Learns from rows with a letter and a language whose crc32(id as text) mod 3 is not 1:
    at most ``fit_docs`` a language, the first by a hash of the id; of a text over ``FIT_BYTES``
    bytes, from the piece that begins with its first letter.  A language without such a row is
    never predicted.  A null text and one without a letter get ``und`` with score 0; so does every
    text if fewer than two languages can be learned and none is known (with one, that
    one).  Null ids are not held out; repeated rows are predicted each; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out("id"))
    usable = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    order = Window.partitionBy("lang").orderBy("order", "id")
    few = (usable.select("id", "lang", F.xxhash64("id").alias("order")).withColumn("n", F.row_number().over(order))
           .where(F.col("n") <= fit_docs).select("id", "lang").distinct())
    piece = (F.when(F.octet_length("text") <= FIT_BYTES, F.col("text"))
             .otherwise(F.regexp_extract("text", f"(?s)\\p{{L}}.{{0,{FIT_BYTES // 4 - 1}}}", 0)))
    sample = sorted((r["lang"], r["text"]) for r in usable.join(F.broadcast(few), ["id", "lang"]).select(piece.alias("text"), "lang").collect())
    sample = [(t, y) for y, t in sample]
    model, key = spark.sparkContext.broadcast(fit(sample) if sample else Chain([])), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain: Chain = model.value
        memo = resident(("chain", key), lambda: WordRows(chain.emissions, max(1, len(chain.langs))))
        for b in batches:
            texts = b["text"].tolist()
            found = [("und", 0.0)] * len(texts)
            for a, z in slices(texts) if chain.langs else ():
                for i, x in label(chain, memo, texts[a:z]).items():
                    found[a + i] = x
            yield pd.DataFrame({"id": b["id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    kind = docs.schema[id_col].dataType
    done = rows.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, lang_pred string, score double")
    done = done.select(F.col("id").cast(kind).alias("id"), "lang_pred", "score")
    return done.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
