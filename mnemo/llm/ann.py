"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into the leaf
that it reaches by descending to the nearest child.  A query walks the tree
through a priority queue ordered by the distance to the node centres and visits
leaves in that order.  How many is calibrated: a bounded set of queries is
answered exactly, and visits are widened until their true neighbours' leaves
are covered to the wanted recall.  Inside the visited leaves distances are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import stage

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
BRANCHES = 8
LEAF_SAMPLE = 400
CALIBRATION_QUERIES = 200
RECALL = 0.95
#: Vectors and queries that meet in one task.
LEAF_ROWS = 20_000
LEAF_QUERIES = 2_000


class Tree:
    """Node i has centre ``centres[i]`` and children ``children[i]``; a node without children is leaf ``leaf[i]``."""

    def __init__(self, sample: np.ndarray):
        self.centres, self.children, self.leaf, self.leaves = [sample.mean(0)], [[]], [-1], 0
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            groups = split(rows, BRANCHES) if len(rows) > LEAF_SAMPLE else []
            if len(groups) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for g in groups:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), g))
                self.centres.append(g.mean(0))
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if not self.children[node]:
                out[at] = self.leaf[node]
                continue
            near = distances(x[at], self.centres[self.children[node]]).argmin(1)
            todo += [(c, at[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            d = ((self.centres[self.children[node]] - q) ** 2).sum(1)
            for c, x in zip(self.children[node], d):
                heapq.heappush(queue, (float(x), c))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the expanded square: for choosing, not for reporting."""
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def split(rows: np.ndarray, k: int, rounds: int = 12) -> list[np.ndarray]:
    """k-means groups; centres start at spread-out distinct rows.  One group if all rows are equal."""
    rng = np.random.default_rng(7)
    centres = rows[:1]
    near = ((rows - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max() > 0:
        pick = rows[rng.choice(len(rows), p=near / near.sum())][None]
        centres = np.vstack([centres, pick])
        near = np.minimum(near, ((rows - pick) ** 2).sum(1))
    for _ in range(rounds):
        who = distances(rows, centres).argmin(1)
        used = np.unique(who)
        centres = np.vstack([rows[who == i].mean(0) for i in used])
    who = distances(rows, centres).argmin(1)
    return [rows[who == i] for i in np.unique(who)]


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, vector id, distance): the k nearest rows of every query but its own, ties to the smaller id.

    Equal vectors are met once; of each only the k + 1 smallest ids can matter.
    """
    order = np.argsort(ids, kind="stable")
    x, ids = np.ascontiguousarray(x[order]), ids[order]
    _, first, who = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(who, kind="stable")
    starts = np.searchsorted(who[by], np.arange(len(first) + 1))
    x = x[first]
    out = []
    for at in range(0, len(q), 64):
        block = distances(q[at:at + 64], x)
        for i, row in enumerate(block):
            query, me = q[at + i], q_ids[at + i]
            # one more than k, as the query's own row may be among them; the margin covers the rounding of the expanded square
            far = np.partition(row, k)[k] if len(row) > k + 1 else np.inf
            close = np.flatnonzero(row <= far + 1e-9 * (abs(far) + (query * query).sum()) if np.isfinite(far) else np.ones(len(row), bool))
            found = [(float(d), int(j)) for d, u in zip(np.sqrt(((x[close] - query) ** 2).sum(1)), close)
                     for j in ids[by[starts[u]:min(starts[u + 1], starts[u] + k + 1)]] if j != me]
            out += [(int(me), j, d) for d, j in heapq.nsmallest(k, found)]
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector as doubles, without rows that take no part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(fine & F.exists("vec", lambda x: x != 0))


def search(vectors: DataFrame, k: int = 10, every: int = 100, recall: float = RECALL,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``, among all other rows.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance in double
    precision on the original vectors); ties go to the smaller id; fewer rows where
    there are fewer candidates.  Rows with a null id, and vectors null, empty, zero, or
    holding null or non-finite components take no part, nor do vectors of another
    than the most frequent dimension (the larger on a tie).  An id that repeats is
    one query (its smallest vector) and never its own neighbour; repeated rows are candidates each.
    Empty tables give an empty result; other columns are not read.

    The tree is fitted on at most ``SAMPLE_ROWS`` rows, calibration uses at most
    ``CALIBRATION_QUERIES`` queries; every row is indexed.  Leaves with more than
    ``LEAF_ROWS`` rows or ``LEAF_QUERIES`` queries are met in blocks.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().collect()
    if not sizes:
        return empty
    dim = max(sizes, key=lambda r: (r["count"], r["dim"]))["dim"]
    rows = rows.where(F.size("vec") == dim)

    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))).toPandas()
    tree = Tree(np.array(sample["vec"].tolist(), float))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=shared.value.assign(np.array(b["vec"].tolist(), float)))

    index = stage(rows.mapInPandas(place, "id long, vec array<double>, leaf long"), "ann-index")
    queries = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec")).withColumnRenamed("id", "query")
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row per leaf of the tree
    visits = calibrate(index, queries, tree, k, recall)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, vec in zip(b["query"], b["vec"]):
                seen = rows_seen = 0
                for leaf in shared.value.visits(np.asarray(vec)):
                    parts = -(-counts.get(leaf, 0) // LEAF_ROWS)
                    out += [(query, vec, leaf, p) for p in range(parts)]
                    seen, rows_seen = seen + 1, rows_seen + counts.get(leaf, 0)
                    if seen >= visits and rows_seen > 2 * k:
                        break
            yield pd.DataFrame(out, columns=["query", "vec", "leaf", "part"])

    probes = stage(queries.mapInPandas(walk, "query long, vec array<double>, leaf long, part long"), "ann-probes")
    asked = {(r["leaf"], r["part"]): -(-r["count"] // LEAF_QUERIES) for r in probes.groupBy("leaf", "part").count().collect()
             if r["count"] > LEAF_QUERIES}
    parts = F.create_map(*[F.lit(x) for leaf, n in counts.items() if n > LEAF_ROWS for x in (leaf, -(-n // LEAF_ROWS))]) \
        if any(n > LEAF_ROWS for n in counts.values()) else F.create_map().cast("map<bigint,bigint>")
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.element_at(parts, F.col("leaf")), F.lit(1)).cast("long"))
    turns = spark.createDataFrame([(leaf, p, n) for (leaf, p), n in asked.items()], "leaf long, part long, turns long")
    left = (index.withColumn("part", part).join(F.broadcast(turns), ["leaf", "part"], "left")
            .withColumn("turn", F.explode(F.sequence(F.lit(1), F.coalesce("turns", F.lit(1))))).drop("turns"))
    right = (probes.join(F.broadcast(turns), ["leaf", "part"], "left")
             .withColumn("turn", F.pmod(F.xxhash64("query"), F.coalesce("turns", F.lit(1))) + 1).drop("turns"))

    def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = nearest(np.array(q["vec"].tolist(), float), q["query"].to_numpy(), np.array(v["vec"].tolist(), float),
                        v["id"].to_numpy(), k) if len(v) and len(q) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    key = ["leaf", "part", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(index: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that a bounded set of queries, answered exactly over all rows, finds ``recall`` of its true neighbours."""
    chosen = queries.orderBy(F.xxhash64("query"), "query").limit(CALIBRATION_QUERIES).collect()
    if not chosen:
        return 1
    q_ids, q = np.array([r["query"] for r in chosen]), np.array([r["vec"] for r in chosen], float)
    known = index.sparkSession.sparkContext.broadcast((q_ids, q))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ids = b["id"].to_numpy()
                out = pd.DataFrame(nearest(known.value[1], known.value[0], np.array(b["vec"].tolist(), float), ids, k),
                                   columns=["query", "id", "d"])
                yield out.merge(b[["id", "leaf"]].drop_duplicates("id"), on="id")

    order = Window.partitionBy("query").orderBy("d", "id")
    true = (index.mapInPandas(exact, "query long, id long, d double, leaf long")
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query", "leaf").collect())
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["query"], []).append(r["leaf"])
    needed = []
    for query, vec in zip(q_ids, q):
        place = {leaf: i for i, leaf in enumerate(tree.visits(vec), 1)}
        needed += [place[leaf] for leaf in wanted.get(int(query), [])]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1
