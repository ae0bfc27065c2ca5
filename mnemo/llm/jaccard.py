"""Exact Jaccard join of word-shingle sets by PartEnum signatures, and its link components.

Sets fall into bands of similar size.  In a band, two sets similar enough differ
in at most k shingles, so if the shingle domain is dealt into parts, some part
differs in few of them, and some subset of its sub-parts in none: similar sets
share the signature of that subset.  Small sets enumerate subsets of sub-parts,
large ones, whose parts are selective anyway, use whole parts.

Spark deals the signatures out by hash, as packed blocks.  Where several sets
share one, the smallest id stands for the others: those pairs are compared
first, on the whole texts, and give components.  Only signatures whose sets still
lie in different components need further pairs; these pass an exact parity-bitmap
bound before the texts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.blocks import SCHEMA, deal, gather
from mnemo.llm.common import give_back, giving_back, let_go, shuffle_partitions, small_batches, stage
from mnemo.llm.shingles import mix, shingles, words_of

#: Similarity in hundredths: sets link when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
SMALL_SET = 256
#: Bytes of text whose signatures one reduce group holds.
GROUP_BYTES = 8 << 20
#: Sets of one signature that are compared in one task.
BLOCK_SETS = 2_048
#: Pairs compared against one representative in one task.
PAIRS_PER_TASK = 256
BITMAP_BITS = 512
#: Lists up to so many sets give their pairs as they are; in longer ones the bitmaps are asked first.
SMALL_LIST = 32
#: Ids that are broadcast at most (8 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


# ---- signatures --------------------------------------------------------------

class Band:
    """Sizes low..high; k is the largest symmetric difference of a linked pair of sets up to ``high``."""

    def __init__(self, number: int, low: int, high: int, percent: int):
        self.low, self.high = low, high
        # 100 c >= p u with u = a + b - c  =>  a + b - 2c <= (a + b)(100 - p) / (100 + p)
        self.k = k = 2 * high * (100 - percent) // (100 + percent)
        if k <= 4:  # one part: of its sub-parts, all but k at most are alike; every three of them sign
            self.parts, self.subs, self.slack = 1, k + 3 if k else 1, 0
            picks = combinations(range(self.subs), 3 if k else 1)
        elif high <= SMALL_SET:  # some part differs in one shingle at most, and two of its three sub-parts in none
            self.slack = -(-k * 3 // 40)
            self.parts, self.subs, picks = k // 2 + 1 + self.slack, 3, combinations(range(3), 2)
        else:  # some part doesn't differ
            self.slack = -(-k * 18 // 100)
            self.parts, self.subs, picks = k + 1 + self.slack, 1, [(0,)]
        self.picks = [list(p) for p in picks]
        self.salt = mix(np.arange(1, self.parts * len(self.picks) + 1, dtype=np.uint64) + np.uint64(number << 32))

    def signatures(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Signatures of a set of hashes, and how many of them a linked set shares at least.

        A part that is empty in the set says nothing; there are enough others unless more than ``slack`` are.
        """
        place = (mix(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)) % np.uint64(self.parts * self.subs)
        place = place.astype(np.int64)
        n = self.parts * self.subs
        # sums of 32-bit halves are exact in doubles: a set has far fewer than 2^21 shingles in one part
        low = np.bincount(place, (x & np.uint64(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
        high = np.bincount(place, (x >> np.uint64(32)).astype(float), n).astype(np.uint64)
        total = mix(low + (high << np.uint64(32)) + (high >> np.uint64(32))).reshape(self.parts, self.subs)
        count = np.bincount(place, minlength=n).reshape(self.parts, self.subs)
        if self.subs == 1:
            sums, sizes = total, count
        elif self.parts == 1:
            tagged = mix(total[0] + np.arange(self.subs, dtype=np.uint64))
            sums = np.array([[tagged[p].sum(dtype=np.uint64) for p in self.picks]])
            sizes = np.array([[count[0, p].sum() for p in self.picks]])
        else:
            sums = np.stack([mix(total[:, a] + np.uint64(1)) + mix(total[:, b] + np.uint64(2)) for a, b in self.picks], 1)
            sizes = np.stack([count[:, a] + count[:, b] for a, b in self.picks], 1)
        sig = mix(sums.ravel() + self.salt)
        bare = sizes == 0
        empty = int(bare.any(1).sum())
        if empty > self.slack:
            return sig, 1
        # as many parts as are left when the differences have spoilt all they can
        alike = self.parts - empty - (self.k if self.subs == 1 else self.k // 2)
        return sig[~bare.ravel()], 1 if self.parts == 1 else max(1, alike)


class Bands:
    def __init__(self, percent: int):
        self.percent, self.bands, self.low = percent, [], 1

    def up_to(self, size: int) -> None:
        while self.low <= size:
            # narrow bands where sub-parts are enumerated, twice as wide ones (in ratio) beyond
            high = self.low * 100 // self.percent
            if high > SMALL_SET:
                high = self.low * 10_000 // self.percent ** 2
            self.bands.append(Band(len(self.bands), self.low, high, self.percent))
            self.low = high + 1

    def signatures(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """For the set's own band, and for the next one if it can have partners there; the fewest that a linked set shares."""
        size = len(x)
        self.up_to(size * 100 // self.percent + 2)
        own = next(i for i, b in enumerate(self.bands) if b.high >= size)
        out = [self.bands[own].signatures(x)]
        for b in self.bands[own + 1:]:
            if 100 * size < self.percent * b.low:
                break
            out.append(b.signatures(x))
        return np.concatenate([sig for sig, _ in out]), min(need for _, need in out)


def bitmap(x: np.ndarray) -> bytes:
    """Parity bitmap: bit i tells whether an odd number of shingles falls on it; longer for larger sets."""
    bits = max(BITMAP_BITS, 1 << max(0, len(x) - 1).bit_length())
    odd = np.bincount(((mix(x + np.uint64(77)) >> np.uint64(11)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(data: bytes, size: int) -> np.ndarray:
    """A longer bitmap brought to ``size`` bytes: positions are taken modulo the length, so halves are XORed."""
    x = np.frombuffer(data, np.uint8)
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


# ---- pass over the texts -----------------------------------------------------

def sign_texts(docs: DataFrame, n: int, percent: int, groups: int) -> DataFrame:
    """Per group p a block of signatures with their ids, and the facts of some documents."""
    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        bands, known = Bands(percent), set()
        sigs, ids, heads, held = [], [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            facts: dict[int, list] = {}
            for h in heads:
                facts.setdefault(h[0] * 2654435761 % (1 << 32) % groups, []).append(h)
            dealt = deal(sigs, ids, groups)
            yield pd.DataFrame([(p, *dealt.get(p, (b"", b"", b"")), *map(list, zip(*facts[p]))) if p in facts else (p, *dealt[p], [], [], [], [], [])
                                for p in sorted({*facts, *dealt})], columns=["p", "ids", "sizes", "hashes", "doc", "n", "need", "key", "bits"])
            sigs.clear(), ids.clear(), heads.clear()

        for b in batches:
            for doc, text in zip(b["doc"], b["text"]):
                x = shingles(words_of(text), n)
                key = blake2b(x.tobytes(), digest_size=16).digest() if len(x) else b""
                need = 0
                if len(x) and key not in known:  # equal sets of this task sign once; they meet by their key
                    known.add(key)
                    sig, need = bands.signatures(x)
                    sigs.append(sig)
                    ids.append(int(doc))
                    held += len(sig)
                heads.append((int(doc), len(x), need, key, bitmap(x) if need else b""))
                if held > 2_000_000 or len(heads) > 20_000:
                    yield from flush()
                    held = 0
        if heads:
            yield from flush()

    return docs.mapInPandas(run, f"{SCHEMA}, doc array<long>, n array<int>, need array<int>, key array<binary>, bits array<binary>")


def meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one group: the documents' facts, and the distinct lists of ids that share a signature."""
    _, ids, first, last = gather(pdf)
    give_back()  # of the group before, and what ordering this one took
    p = int(pdf["p"].iloc[0])
    facts = pd.DataFrame({c: [x for row in pdf[c] for x in row] for c in ("doc", "n", "need", "key", "bits")})
    lists: dict[bytes, int] = {}
    members, uses = [], []
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
        x = np.unique(ids[a:b])
        if len(x) > 1:
            key = x.tobytes() if len(x) < 64 else blake2b(x.tobytes(), digest_size=32).digest()
            at = lists.setdefault(key, len(lists))
            if at == len(members):
                members.append(x)
                uses.append(0)
            uses[at] += 1
    size = [len(x) for x in members]
    shared = pd.DataFrame({"list": np.repeat(np.arange(len(members), dtype=np.int64) + (p << 32), size),
                           "doc": np.concatenate(members) if members else np.zeros(0, np.int64),
                           "rep": np.repeat(np.array([x[0] for x in members], np.int64), size), "uses": np.repeat(np.array(uses, np.int32), size)})
    return pd.concat([facts.astype({"doc": "int64"}), shared], ignore_index=True).astype({"list": "Int64", "rep": "Int64", "n": "Int32", "uses": "Int32", "need": "Int32"})[
        ["list", "doc", "rep", "uses", "n", "need", "key", "bits"]]


# ---- pairs -------------------------------------------------------------------

def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link.  A text that meets many others is sent to several tasks, each with some of them."""
    turns = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("long").alias("turns")), "turns")
    routes = turns.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(None).cast("long").alias("b"))
    routes = routes.unionByName(pairs.join(turns, "a").select(F.col("b").alias("doc"), "a", F.pmod(F.xxhash64("b"), F.col("turns")).alias("turn"), "b"))
    rows = (texts.join(stage(routes, "routes"), "doc").select("a", "turn", "b", "text")
            .repartition(shuffle_partitions(pairs.sparkSession), "a", "turn").sortWithinPartitions("a", "turn", F.col("b").asc_nulls_first()))

    @giving_back
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sets = None, []
        for b in batches:
            out = []
            for a, turn, text, other in zip(b["a"], b["turn"], b["text"], b["b"]):
                x = shingles(words_of(text), n)
                if (a, turn) != at:
                    at, sets = (a, turn), []
                if pd.isna(other):
                    sets.append(x)
                    continue
                for y in sets:
                    common = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
                    if common and 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((a, int(other)))
                        break
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the smallest id reachable, for every id on an edge (a, b)."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "doc"), "labels")
    while True:
        # the smallest label around, then the label of that label
        around = (both.join(labels, both["b"] == labels["doc"]).groupBy("a").agg(F.min("label").alias("near"))
                  .join(labels.withColumnRenamed("label", "own"), F.col("a") == F.col("doc"))
                  .select("doc", "own", F.least("own", "near").alias("near")))
        jump = labels.select(F.col("doc").alias("via"), F.col("label").alias("far"))
        new = stage(around.join(jump, around["near"] == jump["via"], "left")
                    .select("doc", "own", F.least("near", F.coalesce("far", "near")).alias("label")), "labels")
        changed = new.where("label <> own").limit(1).count()
        labels = new.select("doc", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def small_list_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b, uses, need) of whole lists, sorted by list and doc: pairs of different components that may link by their sizes."""
    at = np.flatnonzero(np.diff(rows["list"].to_numpy(), prepend=-1))
    size = np.diff(np.append(at, len(rows)))
    doc, comp, n, need, uses = (rows[c].to_numpy() for c in ("doc", "component", "n", "need", "uses"))
    out = []
    for m in np.unique(size[size > 1]):
        i, j = np.triu_indices(m, 1)
        first = at[size == m][:, None]
        x, y = (first + i).ravel(), (first + j).ravel()
        fine = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[fine], y[fine]
        out.append(np.stack([doc[x], doc[y], uses[x], np.maximum(need[x], need[y])], 1))
    return summed(out)


def summed(parts: list[np.ndarray]) -> pd.DataFrame:
    rows = pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 4), np.int64), columns=["a", "b", "uses", "need"])
    return rows.groupby(["a", "b"], as_index=False).agg({"uses": "sum", "need": "max"})


def large_list_pairs(rows: pd.DataFrame, percent: int) -> list[np.ndarray]:
    """The same for one long list, or two of its blocks: only pairs that the parity bitmaps let pass."""
    own, doc, comp, n, need, uses = (rows[c].to_numpy() for c in ("own", "doc", "component", "n", "need", "uses"))
    size = min(map(len, rows["bits"]))
    bits, across, out = np.stack([fold(b, size) for b in rows["bits"]]), rows["x"].iloc[0] != rows["y"].iloc[0], []
    for i in range(len(doc) - 1):
        fine = (comp[i + 1:] != comp[i]) & (100 * np.minimum(n[i], n[i + 1:]) >= percent * np.maximum(n[i], n[i + 1:]))
        if across:
            fine &= own[i + 1:] != own[i]
        j = np.flatnonzero(fine) + i + 1
        if len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            j = j[apart <= (n[i] + n[j]) * (100 - percent) // (100 + percent)]
            out.append(np.stack([np.full(len(j), doc[i]), doc[j], uses[j], np.maximum(need[i], need[j])], 1))
    return out


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs that share signatures but no component yet, and as many of them as a linked pair must.

    ``lists``: list, m (its sets), doc, component, n, need, uses, bits.  A list of more than BLOCK_SETS
    sets is dealt into blocks, and every two blocks of it meet in one task.
    """
    blocks = F.ceil(F.col("m") / BLOCK_SETS)
    columns = ["list", "x", "y", "own", "doc", "component", "n", "need", "uses", "bits"]
    zero = F.lit(0).cast("long")
    whole = lists.where(F.col("m") <= BLOCK_SETS).select("*", zero.alias("x"), zero.alias("y"), zero.alias("own")).select(*columns)
    dealt = (lists.where(F.col("m") > BLOCK_SETS).withColumn("own", F.pmod(F.xxhash64("doc"), blocks))
             .withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
             .select("*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).select(*columns))

    @giving_back
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            starts = group_starts(b)
            rest = b.iloc[starts[-1]:] if len(starts) else None
            if len(starts) > 1:
                yield list_pairs(b.iloc[:starts[-1]], starts[:-1], percent)
        if rest is not None and len(rest):
            yield list_pairs(rest.reset_index(drop=True), np.zeros(1, np.int64), percent)

    rows = whole.unionByName(dealt).repartition(shuffle_partitions(lists.sparkSession), "list", "x", "y").sortWithinPartitions("list", "x", "y", "doc")
    found = rows.mapInPandas(compare, "a long, b long, uses long, need long")
    return found.groupBy("a", "b").agg(F.sum("uses").alias("uses"), F.max("need").alias("need")).where("uses >= need").select("a", "b")


def group_starts(rows: pd.DataFrame) -> np.ndarray:
    key = rows[["list", "x", "y"]].to_numpy()
    return np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))) if len(key) else np.zeros(0, np.int64)


def list_pairs(rows: pd.DataFrame, starts: np.ndarray, percent: int) -> pd.DataFrame:
    size = np.diff(np.append(starts, len(rows)))
    short = np.repeat(size <= SMALL_LIST, size)
    short &= (rows["x"] == rows["y"]).to_numpy()
    found = [small_list_pairs(rows[short], percent).to_numpy()]
    for a, k in zip(starts, size):
        if not short[a]:
            found += large_list_pairs(rows.iloc[a:a + k], percent)
    return summed(found)


def lowest(rows: DataFrame, same: DataFrame, name: str) -> DataFrame:
    """``name`` replaced by the smallest id with an equal set."""
    least = same.select(F.col("a").alias("_least"), F.col("b").alias("_own"))
    return rows.join(least, F.col(name) == F.col("_own"), "left").withColumn(name, F.coalesce("_least", name)).drop("_least", "_own")


# ---- the operator ------------------------------------------------------------

def jaccard_components(docs: DataFrame, n: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of ``n``-word shingles have 100 * intersection >= ``percent`` * union.

    Words are what stands between ASCII white space, A-Z lower-cased; fewer than
    ``n`` words are one shingle.  Sets are compared by 64-bit hashes of their shingles.

    Returns one row per input row: id, ``n_shingles`` (0 for a null or empty text or
    one without words, which links with nothing), ``component_id`` (smallest id
    reachable by links, itself included; null for a null id, which takes no part).  Rows that share an id
    are one document: each of their texts can link it.  An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = rows.where("doc IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(shuffle_partitions(spark), -(-size // GROUP_BYTES))
    met = stage(sign_texts(known, n, percent, groups).repartition(groups, "p").groupBy("p").applyInPandas(
        meet, "list long, doc long, rep long, uses int, n int, need int, key binary, bits binary"), "shared-signatures")
    facts = met.where("list IS NULL").select("doc", "n", "need", "key", "bits")
    lists = met.where("list IS NOT NULL").select("list", "doc", "rep", "uses")
    sets = stage(facts.where("need > 0").select("doc", "n", "need", "bits").distinct(), "sets")  # several for an id with several texts

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "compared")
        return known.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc", "left_semi")

    # equal sets link; of each only the smallest id goes on
    least = stage(facts.where("n > 0").groupBy("key").agg(F.min("doc").alias("least")), "equal-sets")
    same = stage(facts.join(least, "key").where("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct(), "equal-links")

    # first every set with the smallest of the lists that it is most often in
    star = (lists.where("doc <> rep").groupBy("doc", "rep").agg(F.sum("uses").alias("uses"))
            .groupBy("doc").agg(F.max(F.struct("uses", (-F.col("rep")).alias("less"))).alias("most")).select("doc", "most.uses", (-F.col("most.less")).alias("rep")))
    star = star.join(sets.select("doc", "need"), "doc").where("uses >= need").select("doc", "rep")
    star = lowest(lowest(star, same, "doc"), same, "rep").where("doc <> rep")
    star = stage(star.select(F.least("doc", "rep").alias("a"), F.greatest("doc", "rep").alias("b")).distinct(), "star-pairs")
    links = stage(verified(star, texts_of(star), n, percent).unionByName(same), "star-links")
    comp = components(links)

    # then what shares signatures across components
    labelled = lists.join(comp, "doc", "left").select("list", "doc", "uses", F.coalesce("component", "doc").alias("component"))
    labelled = stage(labelled, "labelled-lists")
    mixed = stage(labelled.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
                  .where("low <> high").select("list", "m"), "mixed-lists")
    more = stage(cross_pairs(labelled.join(mixed, "list").join(sets, "doc"), percent).join(star, ["a", "b"], "left_anti"), "cross-pairs")
    links = links.unionByName(verified(more, texts_of(more), n, percent))
    comp = components(stage(links, "links"))

    counted = facts.select("doc", "n", "key").withColumnRenamed("key", "set_key")
    out = counted.join(comp, "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    nulls = rows.where("doc IS NULL").mapInPandas(
        lambda it: (pd.DataFrame({"n": [len(shingles(words_of(t), n)) for t in b["text"]]}, dtype="int32") for b in it), "n int")
    out = out.unionByName(nulls.select(F.lit(None).cast("long").alias("doc"), "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.col("component").alias("component_id"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles,
    coalesce(least(doc_id, (SELECT min(other) FROM r WHERE r.doc_id = s.doc_id)), doc_id) AS component_id FROM s
"""
