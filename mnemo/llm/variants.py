"""Spelling variants: words one edit apart, by composing acceptors with a one-edit transducer.

The vocabulary's acceptor is cut into partitions that have an initial state each:
of a pair of words one edit apart, the edit lies in the first or in the second
half of the shorter word, so both words share all that stands before and behind
that half.  Words alike in this belong to one partition, and what they have between
is its language.  A partition with too many words is cut once more, at the middle of
its interval, until the interval is one position and the alphabet bounds it.  In a
partition the minimised acceptor of the shorter words is composed with the
transducer that replaces or inserts one symbol, and with the acceptor again.  An
edit counts where the words first differ, which lies in one interval only: every
pair is accepted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import shuffle_partitions, stage

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs so many times as often as its variant, at least.
RATIO = 10
#: Of every so many (document, run) hashes one loses a code point.
DAMAGE = 31
#: Words of a partition; larger ones are cut at their middle.
PARTITION_WORDS = 20_000
#: Partitions to be cut whose keys are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 100_000

KEY = ["low", "lo", "hi", "head", "tail"]


# ---- words -------------------------------------------------------------------

def damaged(run: Column, doc_id: Column) -> Column:
    """The run without its code point h % length if DAMAGE divides h, the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    runs = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(RUNS), F.lit(0)), lambda w: F.length(w) >= least_length)
    rows = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = rows.select(damaged(F.col("run"), F.col("id")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---- partitions --------------------------------------------------------------

def interval(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """``rows`` (low, word, n) under the interval [lo, hi) of a pair whose shorter word has ``low`` code points."""
    rest = F.col("low") - hi
    return rows.select("low", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.substr("word", F.lit(1), lo).alias("head"),
                       F.substr("word", F.length("word") - rest + 1, rest).alias("tail"),
                       F.substr("word", lo + 1, F.length("word") - lo - rest).alias("mid"), "n")


def halves(rows: DataFrame) -> DataFrame:
    """(low, lo, hi, word, n) rows under both halves of their interval."""
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    rows = rows.withColumn("cut", F.explode(F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("hi").alias("b")))))
    return interval(rows, F.col("cut.a"), F.col("cut.b"))


def partitions(words: DataFrame, least_length: int, most: int) -> DataFrame:
    """All words under the intervals of their pairs: as the shorter word (low = length) and as the longer one."""
    roles = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda k: k >= least_length))
    rows = halves(words.select("word", "n", roles.alias("low")).withColumn("lo", F.lit(0)).withColumn("hi", F.col("low")))
    done = None
    while True:
        large = stage(rows.where("hi - lo > 1").groupBy(*KEY).agg(F.count("*").alias("m")).where(F.col("m") > most).drop("m"), "large-partitions")
        count = large.count()
        if not count:
            return rows if done is None else done.unionByName(rows)
        keys = F.broadcast(large) if count <= BROADCAST_KEYS else large
        small = rows.join(keys, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stage(halves(rows.join(keys, KEY, "left_semi").select("low", "lo", "hi", F.concat("head", "mid", "tail").alias("word"), "n")), "cut-partitions")


# ---- acceptors ---------------------------------------------------------------

class Acceptors:
    """Minimised acyclic acceptors over a common set of states: equal right languages are one state.

    State 0 accepts the empty word only.  A state's words are numbered in their order.
    """

    def __init__(self):
        self.arcs: list[tuple] = [()]
        self.count = [1]
        self.known: dict[tuple, int] = {(): 0}
        self.shared: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def state(self, arcs: tuple) -> int:
        at = self.known.get(arcs)
        if at is None:
            at = self.known[arcs] = len(self.arcs)
            self.arcs.append(arcs)
            self.count.append(sum(self.count[t] for _, t in arcs))
        return at

    def accept(self, words: list[str]) -> int:
        """Initial state of the acceptor of distinct words of equal length, in order."""
        length = len(words[0])
        path: list[list] = [[] for _ in range(length)]  # arcs of the states on the way to the last word; the last arc is open
        last = words[0]
        for k, c in enumerate(last):
            path[k].append(c)
        for w in [*words[1:], None]:
            k = 0
            if w is not None:
                while w[k] == last[k]:
                    k += 1
            to = 0
            for depth in range(length - 1, k - 1, -1):  # the states behind the first difference are complete
                path[depth][-1] = (path[depth][-1], to)
                if depth > k or w is None:
                    to = self.state(tuple(path[depth]))
                    path[depth] = []
            if w is None:
                return to
            for depth in range(k, length):
                path[depth].append(w[depth])
            last = w
        return 0

    def common(self, x: int, y: int) -> list[tuple[int, int]]:
        """Numbers in x and in y of the words that both states accept."""
        out = self.shared.get((x, y))
        if out is None:
            out, todo = [], [(x, y, 0, 0)]
            while todo:
                a, b, i, j = todo.pop()
                if a == b:
                    out += zip(range(i, i + self.count[a]), range(j, j + self.count[b]))
                    continue
                todo += [(s, t, i + u, j + v) for _, s, t, u, v in self.matches(a, b)]
            self.shared[x, y] = out
        return out

    def numbered(self, x: int) -> list[tuple[str, int, int]]:
        """(symbol, target, number of its first word) of a state's arcs."""
        out, at = [], 0
        for c, t in self.arcs[x]:
            out.append((c, t, at))
            at += self.count[t]
        return out

    def matches(self, x: int, y: int) -> list[tuple]:
        """(symbol, target in x, target in y, first number in x, first number in y) of the symbols that both read."""
        right = {c: (t, at) for c, t, at in self.numbered(y)}
        return [(c, s, right[c][0], i, right[c][1]) for c, s, i in self.numbered(x) if c in right]


def replaced(m: Acceptors, start: int) -> list[tuple[int, int]]:
    """Numbers (i < j) of the words of a state that differ in one symbol: acceptor, replacing transducer, acceptor."""
    out, todo = [], [(start, 0)]
    while todo:
        x, i = todo.pop()
        arcs = m.numbered(x)
        for k, (_, s, u) in enumerate(arcs):  # no edit so far: both read the same word, so both are in x
            todo.append((s, i + u))
            for _, t, v in arcs[k + 1:]:
                out += [(i + u + a, i + v + b) for a, b in m.common(s, t)]
    return out


def inserted(m: Acceptors, short: int, long: int, at_end: bool) -> list[tuple[int, int]]:
    """Numbers of words of ``short`` and ``long``, the longer having one symbol more: acceptor, inserting transducer, acceptor.

    The symbol counts as inserted where the words first differ; at the end of the shorter word only ``at_end``.
    """
    out, todo = [], [(short, long, 0, 0)]
    while todo:
        x, y, i, j = todo.pop()
        if x == 0:
            if at_end:
                out += [(i, j + v) for _, _, v in m.numbered(y)]
            continue
        left = m.numbered(x)
        for c, t, v in m.numbered(y):
            after = {d: (r, at) for d, r, at in m.numbered(t)}
            for d, s, u in left:
                if d != c and d in after:  # the inserted c, then the shorter word's next symbol d
                    r, w = after[d]
                    out += [(i + u + a, j + v + w + b) for a, b in m.common(s, r)]
        todo += [(s, t, i + u, j + v) for _, s, t, u, v in m.matches(x, y)]
    return out


def partition_pairs(size: int, mids: list[str], at_end: bool) -> list[tuple[int, int]]:
    """Places in ``mids`` of the pairs of one partition; the shorter words have ``size`` symbols here, the others one more."""
    order = sorted(range(len(mids)), key=mids.__getitem__)
    short = [k for k in order if len(mids[k]) == size]
    long = [k for k in order if len(mids[k]) > size]
    if not short:
        return []
    m = Acceptors()
    x = m.accept([mids[k] for k in short])
    out = [(short[a], short[b]) for a, b in replaced(m, x)]
    if long:
        y = m.accept([mids[k] for k in long])
        out += [(short[a], long[b]) for a, b in inserted(m, x, y, at_end)]
    return out


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of every word and every word near it."""
    w = Window.partitionBy(*KEY)
    short = F.length("mid") == F.col("hi") - F.col("lo")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *KEY).select(
        "*", F.count("*").over(w).alias("m"), F.max(short).over(w).alias("any_short")).where("m > 1 AND any_short").drop("m", "any_short")
    columns = ["word", "n", "near", "near_n"]

    def pairs_of(group: pd.DataFrame) -> list[tuple]:
        low, lo, hi, head, tail = (group[c].iloc[0] for c in KEY)
        mids, n = group["mid"].tolist(), group["n"].tolist()
        out = []
        for a, b in partition_pairs(int(hi - lo), mids, hi == low):
            u, v = head + mids[a] + tail, head + mids[b] + tail
            out += [(u, n[a], v, n[b]), (v, n[b], u, n[a])]
        return out

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            starts = group_starts(b)
            rest = b.iloc[starts[-1]:].reset_index(drop=True) if starts else None
            out = [p for i, j in zip(starts, starts[1:]) for p in pairs_of(b.iloc[i:j])]
            yield pd.DataFrame(out, columns=columns)
        if rest is not None:
            yield pd.DataFrame(pairs_of(rest), columns=columns)

    return rows.mapInPandas(compose, "word string, n long, near string, near_n long")


def group_starts(rows: pd.DataFrame) -> list[int]:
    keys = list(zip(*(rows[c].tolist() for c in KEY)))
    return [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]


# ---- the operator ------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms (word, form) of every word ends.  A form is more frequent, so there are no circles."""
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("far"))
        new = stage(at.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")), "roots")
        at = new.select("word", "root")
        if not new.where("went").limit(1).count():
            return at


def spelling_variants(words: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """Variants among distinct ``words`` (word, n) of at least ``least_length`` (two or more) code points.

    Two words are near if one inserted, deleted or replaced code point makes one of the other.  Per word:
    ``form``, its near word of largest n (ties: the smallest by code points) if that n is at least
    ``ratio`` times its own, else null; ``root``, where its forms lead to, or the word itself; ``n``; ``n_near``;
    ``form_n``.  An empty table gives an empty result.
    """
    words = stage(words.select("word", "n"), "vocabulary")
    near = near_words(partitions(words, least_length, partition_words))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                     F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    frequent = F.col("near_n") >= ratio * F.col("n")
    formed = stage(joined.select("word", "n", "n_near", F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants among the words of whole texts: runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased.

    A null, empty or wordless text has no words; a null id counts as an empty string in the hash that damages
    runs; rows that are equal count as often as they occur; other columns are not read.
    """
    return spelling_variants(vocabulary(docs, id_col, text_col))


VARIANTS_SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
        FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
code AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))),
        lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS h FROM low, t),
cut AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || right(run, (length(run) - 1 - h % length(run))::INT) ELSE run END AS word FROM code),
words AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, i, left(word, i::INT) || right(word, (length(word) - 1 - i)::INT) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (i, s) WHERE a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.s = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.s = b.word),
best AS (SELECT * FROM (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k FROM pairs) WHERE k = 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS spot, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN f ON c.spot = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(spot, depth) AS root FROM chain GROUP BY word) USING (word)
"""
