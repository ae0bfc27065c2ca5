"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the vector of the word and the mean vector of its character
n-grams (both hashed).  The network reads windows of words that overlap by half,
in both directions; attention weighs its states, and the pooled state gives the
window's logit.  All windows of a text are scored, the highest decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import giving_back, held_out, resident, slices, small_batches
from mnemo.llm.langid import words_of
from mnemo.llm.wordrows import WordRows, gram_ids, word_batches

#: Labelled documents a class that the network is fitted on at most, and the longest text among them (bytes).
FIT_DOCS = 1_200
FIT_BYTES = 1 << 16
WORD_BUCKETS, GRAM_BUCKETS, GRAM_SIZES = 1 << 15, 1 << 16, (3, 4, 5)
WIDTH, HIDDEN, ATTEND = 8, 8, 8
WINDOW, STRIDE = 32, 16
STEPS, BATCH = 400, 96
MIN_TEXTS = 4
THRESHOLD = 0.7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_ids(word: bytes) -> tuple[int, np.ndarray]:
    return crc32(word) % WORD_BUCKETS, np.array(gram_ids(word, GRAM_SIZES, GRAM_BUCKETS) or [0])


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; the last one reaches the end."""
    return list(range(0, max(1, n - STRIDE), STRIDE))


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        # a word or n-gram that training never met adds nothing
        self.p = {"words": np.zeros((WORD_BUCKETS, WIDTH), np.float32), "grams": np.zeros((GRAM_BUCKETS, WIDTH), np.float32),
                  "att": small(2 * HIDDEN, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": small(ATTEND, 1)[:, 0],
                  "out": small(2 * HIDDEN, 1)[:, 0], "out_b": np.zeros(1, np.float32)}
        for d in "fb":  # input, recurrent, bias; gates in the order update, reset, candidate
            self.p |= {f"x{d}": small(2 * WIDTH, 3 * HIDDEN), f"h{d}": small(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, ids: list[tuple[int, np.ndarray]]) -> np.ndarray:
        sizes = np.array([len(g) for _, g in ids])
        grams = np.concatenate([g for _, g in ids]) if ids else np.zeros(0, np.int64)
        cuts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        mean = np.add.reduceat(self.p["grams"][grams], cuts, axis=0) / sizes[:, None]
        return np.concatenate([self.p["words"][[w for w, _ in ids]], mean], 1)

    def gates(self, words: list[bytes]) -> np.ndarray:
        """What a word adds to the gates of both directions: all that a distinct word has to be computed for."""
        x = self.inputs([word_ids(w) for w in words])
        return np.concatenate([x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]], 1)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows (count, WINDOW, gates of both directions); ``mask`` is 0 past a window's end."""
        n, steps, _ = gates.shape
        states = np.zeros((n, steps, 2 * HIDDEN), np.float32)
        trace = {}
        for d, (at, order) in {"f": (0, range(steps)), "b": (1, range(steps - 1, -1, -1))}.items():
            u, h = self.p[f"h{d}"], np.zeros((n, HIDDEN), np.float32)
            for t in order:
                x, m = gates[:, t, at * 3 * HIDDEN:(at + 1) * 3 * HIDDEN], mask[:, t, None]
                zr = sigmoid(x[:, :2 * HIDDEN] + h @ u[:, :2 * HIDDEN])
                z, r = zr[:, :HIDDEN] * m, zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN:] + (r * h) @ u[:, 2 * HIDDEN:])
                if keep:
                    trace[d, t] = h, z, r, c
                h = h + z * (c - h)
                states[:, t, at * HIDDEN:(at + 1) * HIDDEN] = h
        look = np.tanh(states @ self.p["att"] + self.p["att_b"])
        score = np.where(mask > 0, look @ self.p["att_v"], -1e9)
        share = np.exp(score - score.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        pooled = (states * share[:, :, None]).sum(1)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logit, (states, trace, look, share, pooled)) if keep else logit

    def gradients(self, gates: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean log loss: by parameter, and by the gates."""
        p = self.p
        logit, (states, trace, look, share, pooled) = self.run(gates, mask, keep=True)
        d_logit = (sigmoid(logit) - label) / len(label)
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_share = (states * d_pooled[:, None]).sum(2)
        d_score = share * (d_share - (share * d_share).sum(1, keepdims=True))
        d_look = d_score[:, :, None] * p["att_v"] * (1 - look ** 2)
        g |= {"att_v": (look * d_score[:, :, None]).sum((0, 1)), "att_b": d_look.sum((0, 1)),
              "att": states.reshape(-1, 2 * HIDDEN).T @ d_look.reshape(-1, ATTEND)}
        d_states = share[:, :, None] * d_pooled[:, None] + d_look @ p["att"].T
        d_gates = np.zeros_like(gates)
        steps = gates.shape[1]
        for d, (at, order) in {"f": (0, range(steps - 1, -1, -1)), "b": (1, range(steps))}.items():
            u = p[f"h{d}"]
            g[f"h{d}"], dh = np.zeros_like(u), np.zeros((len(gates), HIDDEN), np.float32)
            for t in order:
                h, z, r, c = trace[d, t]
                dh = dh + d_states[:, t, at * HIDDEN:(at + 1) * HIDDEN]
                dc = dh * z * (1 - c * c)
                d_rh = dc @ u[:, 2 * HIDDEN:].T
                dz = dh * (c - h) * z * (1 - z)
                dr = d_rh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g[f"h{d}"] += np.concatenate([h.T @ dzr, (r * h).T @ dc], 1)
                d_gates[:, t, at * 3 * HIDDEN:(at + 1) * 3 * HIDDEN] = np.concatenate([dzr, dc], 1)
                dh = dh * (1 - z) + d_rh * r + dzr @ u[:, :2 * HIDDEN].T
        return g, d_gates


def window_batch(table: np.ndarray, spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gates and mask of windows given as rows of ``table``."""
    mask = np.zeros((len(spans), WINDOW), np.float32)
    at = np.zeros((len(spans), WINDOW), np.int64)
    for i, s in enumerate(spans):
        at[i, :len(s)], mask[i, :len(s)] = s, 1
    return table[at], mask


def window_logits(net: Network, memo: WordRows, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float]]:
    """(text, start, logit) of every window of every text."""
    for group in word_batches(texts):
        words = [w for i in group for w in texts[i]]
        if not words:
            continue
        rows, at, spans, owner = memo.rows(words), 0, [], []
        for i in group:
            n = len(texts[i])
            for s in windows(n) if n else ():
                spans.append(rows[at + s:at + min(n, s + WINDOW)])
                owner.append((i, s))
            at += n
        for k in range(0, len(spans), 1024):
            logits = net.run(*window_batch(memo.table, spans[k:k + 1024]))
            yield from ((i, s, x) for (i, s), x in zip(owner[k:k + 1024], logits.tolist()))


def text_logits(net: Network, memo: WordRows, texts: list[list[bytes]]) -> np.ndarray:
    """The highest window logit of every text; -inf without words."""
    out = [-np.inf] * len(texts)
    for i, _, x in window_logits(net, memo, texts):
        if x > out[i]:
            out[i] = x
    return np.array(out)


def fit(texts: list[tuple[str, int]], steps: int = STEPS, seed: int = 11) -> Network | None:
    """Train on (text, label).  A labelled text doesn't say which of its windows is toxic: the first
    choice is the one whose words are most typical of label 1, later the one the network scores highest."""
    net, rng = Network(), np.random.default_rng(seed)
    docs = [(words_of(t), y) for t, y in texts]
    docs = [(w, y) for w, y in docs if w]
    sides = [[w for w, y in docs if y == side] for side in (0, 1)]
    if not all(sides):
        return None
    memo: dict[bytes, tuple[int, np.ndarray]] = {}
    seen, seen_words = np.zeros((2, GRAM_BUCKETS)), np.zeros((2, WORD_BUCKETS))
    for w, y in docs:
        for word in set(w).difference(memo):
            memo[word] = word_ids(word)
        seen[y, np.unique(np.concatenate([memo[x][1] for x in set(w)]))] += 1
        seen_words[y, list({memo[x][0] for x in w})] += 1
    # what only a few texts hold would be learned by heart; of the rest, the first coordinate starts as the log odds of the label
    usual = {"grams": (seen.sum(0) >= MIN_TEXTS)[:, None], "words": (seen_words.sum(0) >= MIN_TEXTS)[:, None]}
    start = {}
    for name, c in (("grams", seen), ("words", seen_words)):
        start[name] = (np.log((c[1] + 0.5) / (len(sides[1]) + 1)) - np.log((c[0] + 0.5) / (len(sides[0]) + 1))) * usual[name][:, 0]
        net.p[name][:, 0] = np.clip(start[name], -1, 5) / 2
    odds = start["grams"]
    steps = min(steps, 40 + len(docs) // 5)
    typical = {w: float(odds[g].max()) for w, (_, g) in memo.items()}

    def top_windows(side: int, many: int) -> list[list[bytes]]:
        out = []
        for w in sides[side]:
            score = np.array([typical[x] for x in w])
            ranked = sorted(windows(len(w)), key=lambda s: -np.sort(score[s:s + WINDOW])[-2:].sum())
            out += [w[s:s + WINDOW] for s in ranked[:many]]
        return out

    def any_windows(side: int, many: int) -> list[list[bytes]]:
        return [w[s:s + WINDOW] for w in sides[side] for s in rng.choice(windows(len(w)), many)]

    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    pools = [top_windows(0, 2) + any_windows(0, 2), top_windows(1, 2)]
    for step in range(1, steps + 1):
        if step % (steps // 5) == 0 and step < steps:  # choose the windows anew, with the network
            rows = WordRows(net.gates, 6 * HIDDEN)
            pools[0], pools[1] = any_windows(0, 1) + pools[0][-len(sides[0]):], []
            for side in (0, 1):
                best: dict[int, tuple[float, int]] = {}
                for i, s, x in window_logits(net, rows, sides[side]):
                    best[i] = max(best.get(i, (-np.inf, 0)), (x, s))
                pools[side] += [sides[side][i][s:s + WINDOW] for i, (_, s) in best.items()]
        picks = [pools[y][rng.integers(len(pools[y]))] for y in np.arange(BATCH) % 2]
        label = (np.arange(BATCH) % 2).astype(np.float32)
        words = [x for w in picks for x in w]
        ids = [memo[x] for x in words]
        x = net.inputs(ids)
        known = (rng.random(len(words)) < 0.5).astype(np.float32)[:, None]  # every other word is read by its characters alone
        x[:, :WIDTH] *= known
        flat = np.concatenate([x @ net.p["xf"] + net.p["bf"], x @ net.p["xb"] + net.p["bb"]], 1)
        cuts = np.cumsum([0] + [len(w) for w in picks])
        gates, mask = window_batch(flat, [np.arange(a, b) for a, b in zip(cuts, cuts[1:])])
        g, d_gates = net.gradients(gates, mask, label)
        d_flat = d_gates[mask > 0]
        half = 3 * HIDDEN
        dx = d_flat[:, :half] @ net.p["xf"].T + d_flat[:, half:] @ net.p["xb"].T
        g |= {"xf": x.T @ d_flat[:, :half], "xb": x.T @ d_flat[:, half:], "bf": d_flat[:, :half].sum(0), "bb": d_flat[:, half:].sum(0)}
        sizes = np.array([len(q) for _, q in ids])
        for name, at, d in (("words", np.array([w for w, _ in ids]), dx[:, :WIDTH] * known),
                            ("grams", np.concatenate([q for _, q in ids]), np.repeat(dx[:, WIDTH:] / sizes[:, None], sizes, axis=0))):
            g[name] = np.stack([np.bincount(at, d[:, j], len(net.p[name])) for j in range(WIDTH)], 1) * usual[name]
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (m, v) in state.items():
            m *= 0.9
            m += 0.1 * g[k]
            v *= 0.99
            v += 0.01 * g[k] ** 2
            net.p[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    calibrate(net, [w for w, _ in docs], np.array([y for _, y in docs]))
    return net


def calibrate(net: Network, texts: list[list[bytes]], label: np.ndarray, rounds: int = 500) -> None:
    """Logistic scaling of a text's highest logit, both classes weighted alike, so that the score is a probability of the text."""
    x = text_logits(net, WordRows(net.gates, 6 * HIDDEN), texts)
    # a clean text taken for toxic weighs more: there are many more of them
    weight = np.where(label == 1, 0.1 / max(1, (label == 1).sum()), 0.9 / max(1, (label == 0).sum()))
    mean, spread = x.mean(), x.std() + 1e-6
    a, b, u = 1.0, 0.0, (x - mean) / spread
    for _ in range(rounds):
        d = (sigmoid(a * u + b) - label) * weight
        a, b = a - 5 * ((d * u).sum() + 0.0005 * a), b - 5 * d.sum()
    net.scale, net.shift = float(max(a, 0.01) / spread), float(b - max(a, 0.01) * mean / spread)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, fit_docs: int = FIT_DOCS, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every whole text: id, the text and the columns of ``keep`` if any are named, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Learns from labelled rows whose crc32(id as text) mod 3 is not 1: at most
    ``fit_docs`` a label, the first by a hash of the id, of at most ``FIT_BYTES`` bytes.  An id with both
    labels counts as toxic; null labels and ids are not learned from.  A null text
    and one without words score 0, and all do if either label is missing.  Repeated
    rows are scored each; an empty table gives an empty result; columns not named are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       (F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")).alias("rest"))
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
              .where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")))
    order = Window.partitionBy("y").orderBy("order", "id")
    few = (marked.withColumn("order", F.xxhash64("id")).withColumn("n", F.row_number().over(order))
           .where(F.col("n") <= fit_docs).select("id", "y"))
    sample = rows.select("id", "text").where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(few), "id").select("text", "y").distinct()
    sample = sorted((r["text"], r["y"]) for r in sample.collect())
    model, key = spark.sparkContext.broadcast(fit(sample)), uuid.uuid4().hex

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = model.value
        memo = None if net is None else resident(("network", key), lambda: WordRows(net.gates, 6 * HIDDEN))
        for b in batches:
            texts, parts = b.column("text").to_pylist(), []
            for a, z in slices(texts):
                parts.append(text_logits(net, memo, [words_of(t) if t else [] for t in texts[a:z]]) if net else np.full(z - a, -np.inf))
            x = np.concatenate(parts) if parts else np.zeros(0)
            score = np.where(np.isfinite(x), sigmoid(net.scale * x + net.shift) if net else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "score"])

    done = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    kept = [F.col("text").alias(text_col), *[F.col("rest")[c].alias(c) for c in keep]] if keep else []
    return done.select(F.col("id").alias(id_col), *kept, held_out("id").alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
