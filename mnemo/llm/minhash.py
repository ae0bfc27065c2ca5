"""MinHash near-duplicates by tensored banding.

Two small collections of sub-keys are made of a set's minima, and a table's key is a
pair of sub-keys, one of each collection: 16 + 16 sub-keys of 3 minima each (96
minima) index 256 tables whose keys hold 6 minima, for which 1,536 would be needed
one by one.  Two sets meet if they share a sub-key of both collections.

A sub-key that no other set has can't be in a shared table key, so only sets that
share sub-keys of both collections make pairs of them, and only of those.  In every
table key the smallest id stands for the others: those pairs are verified first, on
the full sets, and give components; only table keys whose sets still lie in different
components need further pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import slices, stage
from mnemo.llm.jaccard import BROADCAST_IDS, bitmap, components, cross_pairs, lowest, verified
from mnemo.llm.shingles import mix, shingles, words_of

SHINGLE_WORDS = 3
#: Sets link when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
#: Minima in a sub-key, and sub-keys in each of the two collections.  At a similarity of 0.85 sets miss each
#: other with a probability of 2 * (1 - 0.85 ** 3) ** 16 = 5e-7, at 0.9 of 6e-10.
MINIMA = 3
SUBKEYS = 16


class SubKeys:
    """Two collections of ``m`` sub-keys of ``r`` minima each."""

    def __init__(self, r: int = MINIMA, m: int = SUBKEYS):
        self.r, self.m, n = r, m, 2 * r * m
        seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.salt, self.factor = seeds[:n], seeds[n:] | np.uint64(1)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of 2 * m sub-keys for every set of hashes; no set is empty."""
        x = np.concatenate(sets)
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        out = np.zeros((len(sets), 2 * self.m), np.uint64)
        for k, (s, f) in enumerate(zip(self.salt, self.factor)):
            low = np.minimum.reduceat(mix_fast(x ^ s, f), first)
            j = k // self.r
            out[:, j] = mix(out[:, j] + low + np.uint64(j + 1))
        return out


def mix_fast(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    """One round of mixing: the inputs are mixed hashes already."""
    x = x * factor
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def sign_texts(docs: DataFrame, n: int) -> DataFrame:
    """(doc, n, key, subs, bits): the set's size, digest, sub-keys and parity bitmap; the last two only for a task's first set of equal ones."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        collections, known = SubKeys(), set()
        for b in batches:
            texts = b["text"].tolist()
            for i, j in slices(texts):
                rows, sets, at = [], [], []
                for doc, text in zip(b["doc"].iloc[i:j], texts[i:j]):
                    x = shingles(words_of(text), n)
                    key = blake2b(x.tobytes(), digest_size=16).digest() if len(x) else b""
                    first = len(x) > 0 and key not in known
                    if first:
                        known.add(key)
                        sets.append(x)
                        at.append(len(rows))
                    rows.append([doc, len(x), key, None, bitmap(x) if first else None])
                if sets:
                    for k, subs in zip(at, collections.of(sets).view(np.int64)):
                        rows[k][3] = subs
                yield pd.DataFrame(rows, columns=["doc", "n", "key", "subs", "bits"])

    return docs.mapInPandas(run, "doc long, n int, key binary, subs array<long>, bits binary")


def table_keys(sets: DataFrame) -> DataFrame:
    """(tablekey, doc) of sets (doc, subs) whose sub-keys of both collections are shared with others."""
    subs = stage(sets.select("doc", F.posexplode("subs").alias("j", "sub")), "sub-keys")
    shared = subs.groupBy("sub").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("sub")
    mine = subs.join(stage(shared, "shared-sub-keys"), "sub", "left_semi")
    both = mine.groupBy("doc").agg(F.collect_list(F.when(F.col("j") < SUBKEYS, F.col("sub"))).alias("a"), F.collect_list(F.when(F.col("j") >= SUBKEYS, F.col("sub"))).alias("b"))
    return both.select("doc", "b", F.explode("a").alias("x")).select("doc", "x", F.explode("b").alias("y")).select("doc", F.xxhash64("x", "y").alias("tablekey"))


def shared_lists(keys: DataFrame) -> DataFrame:
    """(list, doc, rep, uses): the distinct lists of documents that share table keys, their smallest id, and of how many keys."""
    keys = stage(keys, "table-keys")
    # equal lists have the same size, ends and fingerprints; one key stands for all of theirs
    met = keys.groupBy("tablekey").agg(F.count("*").alias("m"), F.min("doc").alias("rep"), F.max("doc").alias("high"),
                                       F.bit_xor(F.xxhash64("doc")).alias("f"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("g")).where("rep < high")
    lists = stage(met.groupBy("m", "rep", "high", "f", "g").agg(F.min("tablekey").alias("tablekey"), F.count("*").alias("uses")), "lists")
    return stage(keys.join(lists.select("tablekey", "rep", "uses"), "tablekey").select(F.col("tablekey").alias("list"), "doc", "rep", F.col("uses").cast("int").alias("uses")), "shared-lists")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of ``n``-word shingles have 100 * intersection >= ``percent`` * union.

    Words are what stands between ASCII white space, A-Z lower-cased; fewer than ``n`` words are
    one shingle.  Sets are compared by 64-bit hashes of their shingles.

    Returns one row per input row: id, ``n_shingles`` (0 for a null or empty text or one
    without words, which links with nothing), ``component_id`` (smallest id reachable by links,
    itself included) and ``kept`` (the id is the component's).  Rows that share an id are one document:
    each of their texts can link it.  A null id takes no part: its component is null, and it is kept.
    An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = rows.where("doc IS NOT NULL")
    facts = stage(sign_texts(known, n), "signed-sets")

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "compared")
        return known.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc", "left_semi")

    # equal sets link; of each only the smallest id goes on, by what any task's first row of it holds
    least = stage(facts.where("n > 0").groupBy("key").agg(F.min("doc").alias("least")), "equal-sets")
    same = stage(facts.join(least, "key").where("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct(), "equal-links")
    signed = facts.where("subs IS NOT NULL").join(least, "key")
    sets = stage(signed.groupBy("key").agg(F.first("least").alias("doc"), F.first("n").alias("n"), F.first("subs").alias("subs"), F.first("bits").alias("bits")), "sets")
    lists = shared_lists(table_keys(sets.select("doc", "subs")).distinct())

    # first every set with the smallest of the lists that it is most often in
    star = (lists.where("doc <> rep").groupBy("doc", "rep").agg(F.sum("uses").alias("uses"))
            .groupBy("doc").agg(F.max(F.struct("uses", (-F.col("rep")).alias("less"))).alias("most")).select("doc", (-F.col("most.less")).alias("rep")))
    star = lowest(lowest(star, same, "doc"), same, "rep").where("doc <> rep")
    star = stage(star.select(F.least("doc", "rep").alias("a"), F.greatest("doc", "rep").alias("b")).distinct(), "star-pairs")
    links = stage(verified(star, texts_of(star), n, percent).unionByName(same), "star-links")
    comp = components(links)

    # then what shares table keys across components
    labelled = stage(lists.join(comp, "doc", "left").select("list", "doc", "uses", F.coalesce("component", "doc").alias("component")), "labelled-lists")
    mixed = stage(labelled.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
                  .where("low <> high").select("list", "m"), "mixed-lists")
    members = sets.select("doc", "n", F.lit(1).alias("need"), "bits")
    more = stage(cross_pairs(labelled.join(mixed, "list").join(members, "doc"), percent).join(star, ["a", "b"], "left_anti"), "cross-pairs")
    comp = components(stage(links.unionByName(verified(more, texts_of(more), n, percent)), "links"))

    out = facts.join(comp, "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    nulls = rows.where("doc IS NULL").mapInPandas(
        lambda it: (pd.DataFrame({"n": [len(shingles(words_of(t), n)) for t in b["text"]]}, dtype="int32") for b in it), "n int")
    out = out.unionByName(nulls.select(F.lit(None).cast("long").alias("doc"), "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(least(doc_id, low), doc_id) AS component_id, doc_id = coalesce(least(doc_id, low), doc_id) AS kept
FROM s LEFT JOIN c USING (doc_id)
"""
