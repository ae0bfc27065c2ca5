"""Repeated passages by sparse suffix arrays.

Suffixes are kept at content-selected positions only: word positions whose n-gram
hash is the least of a window, so that every passage long enough has one near its
start, the same in all copies.  Suffixes whose first words occur once go at once.
The others are sorted over the whole corpus; neighbours in this order share
the longest beginnings, and a second order by what stands before (read backwards)
gives the longest common ends.  Matches are so extended right and left, and their
words united per document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.blocks import SCHEMA, deal, gather
from mnemo.llm.common import shuffle_partitions, stage
from mnemo.llm.shingles import SLICE_WORDS, spans_hash, window_hash, words_of

#: Passages of so many words and more are found wherever they repeat.
MIN_WORDS = 50
#: A suffix is kept in every window of so many words ...
WINDOW = 25
#: ... at its least n-gram of so many words.
GRAM = 4
GROUP_BYTES = 32 << 20
#: So many contexts a group are looked at to choose the ranges, of one in so many documents at the least.
SAMPLED, SAMPLED_DOCS = 40, 32
#: Of documents that hold more than one part in so many of a group's contexts, some are looked at in each.
LARGE = 16


def anchors(words: list[bytes], least: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions that have ``least`` words from there on, and the hash of these words."""
    at, hashes = [], []
    step = SLICE_WORDS
    for i in range(0, max(1, len(words)), step):
        part = words[i:i + step + window + least + gram]
        if len(part) < max(least, window + gram - 1):
            break
        spans = spans_hash(part)
        grams = window_hash(*spans, gram)
        if len(grams) < window:
            break
        picked = np.unique(np.lib.stride_tricks.sliding_window_view(grams, window).argmin(1) + np.arange(len(grams) - window + 1))
        long = window_hash(*spans, least)
        picked = picked[picked < len(long)]
        at.append(picked + i)
        hashes.append(long[picked])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(hashes)[first]


def common_words(a: str, b: str) -> int:
    """Whole words that two contexts, each word closed by a space, begin with alike."""
    if a == b:
        return a.count(" ")
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a.startswith(b[low:mid], low):
            low = mid
        else:
            high = mid - 1
    return a.count(" ", 0, low)


def matched(key: str, others: list[str], at: int, least: int) -> list[tuple[int, int]]:
    """Word spans that a sorted context shares with its neighbours: from ``at`` on, or before it."""
    most = max((common_words(key, o) for o in others if o[0] == key[0]), default=0)
    if key[0] == "R":
        return [(at, at + most)] if most >= least else []
    return [(at - most + 1, at)] if most > 1 else []  # its first word is the hash of what follows


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of ``min_words`` words and more that occur more than once.

    Words are what stands between ASCII white space, compared exactly.  Every word of
    every passage of at least ``min_words`` words that occurs at two places, in two
    documents or in one, is reported.  What is reported are runs of at least
    ``min_words`` words, each word of which lies in a passage of at least
    ``min_words - window + 1`` words that occurs at two places.

    Returns one row per id with such a run: id, ``starts`` and ``ends`` (word
    positions, end exclusive, in order), ``n_words`` (of all runs together).  Null and
    empty texts have none; rows with a null id take no part; rows that repeat an id
    and a text repeat its passages, and rows that share an id share a result row;
    an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    least = min_words - window + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(shuffle_partitions(spark), -(-size // GROUP_BYTES))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, ids, held = [], [], 0
        for b in batches:
            for doc, text in zip(b["doc"], b["text"]):
                _, h = anchors(words_of(text, lower=False), least, window, gram)
                if len(h):
                    hashes.append(h)
                    ids.append(int(doc))
                    held += len(h)
                if held > 2_000_000:
                    yield pd.DataFrame([(p, *x) for p, x in deal(hashes, ids, groups).items()], columns=["p", "ids", "sizes", "hashes"])
                    hashes, ids, held = [], [], 0
        if held:
            yield pd.DataFrame([(p, *x) for p, x in deal(hashes, ids, groups).items()], columns=["p", "ids", "sizes", "hashes"])

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        h, ids, first, last = gather(pdf)
        many = np.repeat(last - first > 1, last - first)
        order = np.lexsort((h[many], ids[many]))
        ids, h = ids[many][order], h[many][order]
        cut = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else np.zeros(0, np.int64)
        return pd.DataFrame({"doc": ids[cut], "known": [np.unique(x).tobytes() for x in np.split(h, cut[1:])] if len(ids) else [],
                             "places": np.diff(np.append(cut, len(ids)))})

    known = (rows.mapInPandas(sign, SCHEMA).repartition(groups, "p").groupBy("p").applyInPandas(repeated, "doc long, known binary, places long")
             .groupBy("doc").agg(F.collect_list("known").alias("known"), F.sum("places").alias("places")))
    known = stage(known, "repeated-anchors")
    low48 = np.uint64((1 << 48) - 1)

    def contexts(batches: Iterator[pd.DataFrame], bounds: list[tuple]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, doc, known in zip(b["text"], b["doc"], b["known"]):
                words = words_of(text, lower=False)
                at, h = anchors(words, least, window, gram)
                twice = np.isin(h & low48, np.frombuffer(b"".join(known), np.uint64))
                plain, out = [w.decode("utf-8", "replace") for w in words], []
                n, size = len(plain), np.array([len(w) + 1 for w in plain], np.int64)
                ahead, back = " ".join(plain) + " ", " ".join(reversed(plain)) + " "
                at_ahead, at_back = ([0, *np.cumsum(x).tolist()] for x in (size, size[::-1]))  # where the words begin
                for i, x in zip(at[twice].tolist(), h[twice].tolist()):
                    out.append(("R" + ahead[at_ahead[i]:at_ahead[min(i + least + window, n)]], doc, i))
                    out.append((f"L{x:016x} " + back[at_back[n - i]:at_back[min(n - i + window, n)]], doc, i))
                for k in range(0, len(out), 20_000):
                    part = out[k:k + 20_000]
                    yield pd.DataFrame([(*x, bisect_right(bounds, x)) for x in part], columns=["key", "doc", "at", "range"])

    # the ranges are chosen by some contexts of a share of the documents, and of those that hold much of a range: those of all are made once
    schema = "key string, doc long, at int, range int"
    n_contexts = 2 * (known.agg(F.sum("places")).first()[0] or 0)
    docs_in = max(1, min(SAMPLED_DOCS, int(n_contexts // (SAMPLED * groups))))
    rows_in = max(1, int(n_contexts // docs_in // (SAMPLED * groups)))
    large = F.broadcast(known.where(2 * F.col("places") > n_contexts / (LARGE * groups)).select("doc", F.lit(docs_in).alias("of")))

    def some(df: DataFrame) -> DataFrame:
        return df.join(large, "doc", "left").where(F.col("of").isNotNull() | (F.pmod(F.xxhash64("doc"), F.lit(docs_in)) == 0))

    sample = some(rows).drop("of").join(some(known).drop("of"), "doc").mapInPandas(lambda b: contexts(b, []), schema).join(large, "doc", "left")
    sample = sample.where(F.pmod(F.xxhash64("key", "doc", "at"), F.lit(rows_in) * F.coalesce("of", F.lit(1))) == 0)
    seen = sorted(tuple(r) for r in sample.select("key", "doc", "at").collect())
    ranges = spark.sparkContext.broadcast([seen[len(seen) * i // groups] for i in range(1, groups)] if seen else [])
    suffixes = rows.join(known, "doc").mapInPandas(lambda b: contexts(b, ranges.value), schema)
    order = suffixes.repartitionById(groups, "range").drop("range").sortWithinPartitions("key", "doc", "at")

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, last = TaskContext.get().partitionId(), None, None
        for b in batches:
            out = []
            for row in zip(b["key"], b["doc"], b["at"]):
                if last is None:
                    out.append((row[1], row[2], None, part, 0, row[0]))
                else:
                    out += [(last[1], x, y, None, None, None) for x, y in
                            matched(last[0], [row[0]] if before is None else [before, row[0]], last[2], least)]
                    before = last[0]
                last = row
            yield pd.DataFrame(out, columns=["doc", "start", "end", "part", "side", "key"]).astype(
                {"doc": "Int64", "start": "Int64", "end": "Int64", "part": "Int64", "side": "Int64"})
        if last is not None:
            out = [(last[1], x, y, None, None, None) for x, y in matched(last[0], [before] if before else [], last[2], least)]
            out.append((last[1], last[2], None, part, 1, last[0]))
            yield pd.DataFrame(out, columns=["doc", "start", "end", "part", "side", "key"]).astype(
                {"doc": "Int64", "start": "Int64", "end": "Int64", "part": "Int64", "side": "Int64"})

    found = stage(order.mapInPandas(neighbours, "doc long, start long, end long, part long, side long, key string"), "neighbours")
    # neighbours that two partitions part: one row from either side of each border
    edges = sorted(tuple(r) for r in found.where("key IS NOT NULL").select("part", "side", "key", "doc", "start").collect())
    across = [(row[3], x, y) for a, b in zip(edges, edges[1:]) if a[0] != b[0]
              for row, other in ((a, b), (b, a)) for x, y in matched(row[2], [other[2]], row[4], least)]
    spans = found.where("key IS NULL").select("doc", "start", "end").unionByName(
        spark.createDataFrame(across, "doc long, start long, end long"))

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, spans in zip(b["doc"], b["spans"]):
                runs: list[list[int]] = []
                for s in sorted((int(s["start"]), int(s["end"])) for s in spans):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                runs = [r for r in runs if r[1] - r[0] >= min_words]
                if runs:
                    out.append((doc, [r[0] for r in runs], [r[1] for r in runs], sum(r[1] - r[0] for r in runs)))
            yield pd.DataFrame(out, columns=["doc", "starts", "ends", "n_words"])

    # a document has at most two spans for each of its kept positions
    return (spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
            .mapInPandas(unite, "doc long, starts array<long>, ends array<long>, n_words long")
            .withColumn("doc", F.col("doc").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc", id_col))
