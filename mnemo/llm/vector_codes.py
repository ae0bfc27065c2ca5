"""Vector codes by member-resident Lloyd rounds: one codebook of 64 entries for each of 16 parts.

Every vector is cut into parts of integers.  A part lives with the owner of its
present entry: rows are partitioned by (position, entry, salt), many parts packed
in one row.  A round's new entries are the means that owners add up over their
resident members; then owners assign their members anew, and only the parts whose
entry changes go through the next shuffle, to their new owners.  The codebooks, 64
entries of the vectors' length whatever the size of the table, are all that the
driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import shuffle_partitions, stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components are held to +-2^27 (x beyond +-524,288), so that the distances of a whole vector fit 64 bits.
MOST = 1 << 27
#: There are as many owners of an entry as hold so many members each, should all vectors choose that entry.
OWNER_ROWS = 65_536
#: Vectors per partition, at most 64 MB of packed parts for vectors of 64 small components.
PARTITION_VECTORS = 250_000
#: Vectors whose parts are dealt out together.
DEAL_ROWS = 50_000
#: Labels whose sums are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 100_000

BLOCK = "position int, entry int, salt int, wide boolean, keys binary, parts binary"


class Codebooks:
    """``entries[p]``: int64 matrix of part p's entries; parts are cut at ``cuts``."""

    def __init__(self, vectors: np.ndarray, parts: int):
        d = vectors.shape[1]
        self.cuts = [p * d // parts for p in range(parts + 1)]
        self.entries = [vectors[:, a:b].copy() for a, b in zip(self.cuts, self.cuts[1:])]

    def nearest(self, position: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row (the lower one of equals) and the squared distance."""
        c = self.entries[position]
        best, at = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for i in range(0, len(x), 8_192):
            part = x[i:i + 8_192]
            far = np.zeros((len(part), len(c)), np.int64)
            for k in range(c.shape[1]):
                far += (part[:, k, None] - c[:, k]) ** 2
            at[i:i + 8_192] = far.argmin(1)
            best[i:i + 8_192] = far[np.arange(len(part)), at[i:i + 8_192]]
        return at, best

    def digest(self) -> str:
        return sha256(",".join(str(x) for c in self.entries for x in c.ravel().tolist()).encode()).hexdigest()


# ---- blocks of parts ---------------------------------------------------------

def block_rows(position: int, entry: np.ndarray, salts: int, keys: np.ndarray, x: np.ndarray) -> list[tuple]:
    """One row per entry with its members' keys and integers (16 bits each where all of them fit); its salt follows from the first key."""
    order = np.argsort(entry, kind="stable")
    first = np.flatnonzero(np.diff(entry[order], prepend=-1))
    out = []
    for a, b in zip(first, np.append(first[1:], len(order))):
        at = order[a:b]
        part, salt = x[at], (int(keys[at[0]]) * 0x9E3779B97F4A7C15 >> 24) % salts
        wide = bool(part.size) and bool((part != part.astype(np.int16)).any())
        out.append((position, int(entry[at[0]]), salt, wide, keys[at].tobytes(), part.astype(np.int32 if wide else np.int16).tobytes()))
    return out


def members(position: int, wide: bool, keys: bytes, parts: bytes, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    width = books.cuts[position + 1] - books.cuts[position]
    k = np.frombuffer(keys, np.int64)
    return k, np.frombuffer(parts, np.int32 if wide else np.int16).reshape(len(k), width).astype(np.int64)


def to_owners(rows: DataFrame, vectors: int) -> DataFrame:
    return rows.repartition(max(-(-vectors // PARTITION_VECTORS), shuffle_partitions(rows.sparkSession)), "position", "entry", "salt")


def assigned_parts(numbered: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """Blocks of all parts under their nearest entries."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in several(batches):
            keys, q = b["key"].to_numpy(np.int64), np.stack(b["q"].to_numpy()).astype(np.int64)
            rows = []
            for p, (lo, hi) in enumerate(zip(books.cuts, books.cuts[1:])):
                rows += block_rows(p, books.nearest(p, q[:, lo:hi])[0], salts, keys, q[:, lo:hi])
            yield pd.DataFrame(rows, columns=["position", "entry", "salt", "wide", "keys", "parts"])

    return numbered.select("key", "q").mapInPandas(deal, BLOCK)


def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together up to DEAL_ROWS rows, none empty."""
    held, n = [], 0
    for b in batches:
        if n and n + len(b) > DEAL_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
        if len(b):
            held.append(b)
            n += len(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def updated(resident: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry becomes the floor of its resident members' mean; entries without members stay."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for p, e, wide, keys, parts in zip(b["position"], b["entry"], b["wide"], b["keys"], b["parts"]):
                k, x = members(p, wide, keys, parts, books)
                held = sums.setdefault((p, e), [0, 0])
                held[0] += len(k)
                held[1] = held[1] + x.sum(0)
        yield pd.DataFrame([(p, e, i, n, int(s)) for (p, e), (n, total) in sums.items() for i, s in enumerate(total)],
                           columns=["position", "entry", "i", "n", "s"])

    rows = resident.mapInPandas(add, "position int, entry int, i int, n long, s long")
    new = object.__new__(Codebooks)
    new.cuts, new.entries = books.cuts, [c.copy() for c in books.entries]
    # one row per component of an entry: 64 * the vectors' length at most
    for r in rows.groupBy("position", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        new.entries[r["position"]][r["entry"], r["i"]] = int(r["s"]) // r["n"]
    return new


def reassigned(resident: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """Blocks as they are after a new assignment; ``moved`` marks those of parts that have another entry now."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, gone = [], {}
            for p, e, wide, keys, parts in zip(b["position"], b["entry"], b["wide"], b["keys"], b["parts"]):
                k, x = members(p, wide, keys, parts, books)
                now = books.nearest(p, x)[0]
                stay = now == e
                if stay.any():
                    out += [(False, *r) for r in block_rows(p, now[stay], salts, k[stay], x[stay])]
                if not stay.all():
                    gone.setdefault(p, []).append((now[~stay], k[~stay], x[~stay]))
            for p, rows in gone.items():
                out += [(True, *r) for r in block_rows(p, np.concatenate([r[0] for r in rows]), salts, *(np.concatenate([r[i] for r in rows]) for i in (1, 2)))]
            yield pd.DataFrame(out, columns=["moved", "position", "entry", "salt", "wide", "keys", "parts"])

    return resident.mapInPandas(assign, f"moved boolean, {BLOCK}")


def final_codes(resident: DataFrame, books: Codebooks) -> DataFrame:
    """(key, code, error) of every vector."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, wide, keys, parts in zip(b["position"], b["wide"], b["keys"], b["parts"]):
                k, x = members(p, wide, keys, parts, books)
                out.append((k, np.full(len(k), p, np.int32), *books.nearest(p, x)))
            if out:
                yield pd.DataFrame(dict(zip(("key", "position", "entry", "far"), map(np.concatenate, zip(*out)))))

    def half(first: int) -> str:
        return (f"lower(lpad(hex(bit_or(CASE WHEN position BETWEEN {first} AND {first + 7} "
                f"THEN shiftleft(entry, 8 * ({first + 7} - position)) ELSE 0L END)), 16, '0'))")

    return resident.mapInPandas(assign, "key long, position int, entry long, far long").groupBy("key").agg(
        F.expr(f"concat({half(0)}, {half(8)})").alias("code"), F.sum("far").alias("error"))


# ---- the operator ------------------------------------------------------------

def kept_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null or empty and has only finite components, with its integers ``q``."""
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(x, lambda v: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), v.cast("double") * SCALE)))
    return rows.where(fine).withColumn("q", F.transform(held, lambda v: F.floor(v).cast("int")))


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", owner_rows: int = OWNER_ROWS) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors, and the codebooks after ``rounds`` rounds of Lloyd's method.

    A component x counts as floor(256 * x), held to +-2^27.  The codebooks start as the parts of the 64
    rows with the smallest ids (of rows with equal ids the smaller vectors first; fewer rows, fewer entries).
    Parts are as long as one another if 16 divides the vectors' length, else cut as evenly as can be.

    The frame has id, ``label``, ``code`` (two hex digits a part), ``error`` (squared distances summed), a row
    for every row kept: rows that are equal count as often as they occur, rows with a null id are coded but start
    no entry (unless no row has an id: then the result is empty, with None for the codebooks).  Left out
    are rows whose vector is null, empty, holds a null or a non-finite component, or isn't as long as that of the smallest
    id.  An empty table gives an empty frame and None; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    # the key of a row is fixed once it is written
    numbered = stage(kept_vectors(rows, "vector").select(F.monotonically_increasing_id().alias("key"), "id", "label", "q"), "vectors")
    start = numbered.where("id IS NOT NULL").orderBy("id", "q").limit(ENTRIES).select("q").collect()
    width = len(start[0]["q"]) if start else 0
    numbered = numbered.where(F.size("q") == width)
    if not start:
        return numbered.select(F.col("id").alias(id_col), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), None
    books = Codebooks(np.array([r["q"] for r in start if len(r["q"]) == width], np.int64), PARTS)
    n = numbered.count()
    salts = -(-n // owner_rows)
    resident = stage(to_owners(assigned_parts(numbered, books, salts), n), "resident-parts")
    for r in range(rounds):
        books = updated(resident, books)
        if r + 1 < rounds:
            assigned = stage(reassigned(resident, books, salts), "assigned-parts")
            moved = stage(to_owners(assigned.where("moved").drop("moved"), n), "moved-parts")
            resident = assigned.where("NOT moved").drop("moved").unionByName(moved)
    codes = final_codes(resident, books)
    return numbered.join(codes, "key").select(F.col("id").alias(id_col), "label", "code", "error"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over rows of equal labels, null labels together."""
    coded = stage(coded, "vector-codes")
    sums = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def codes_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the query's digest."""
    def assign(n: int) -> str:
        return (f"d{n} AS (SELECT v.r, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS far "
                f"FROM parts v JOIN b{n} b USING (p)),\n"
                f"a{n} AS (SELECT r, p, e, far FROM d{n} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY far, e) = 1),\n")

    def update(n: int) -> str:
        return (f"m{n} AS (SELECT a.p, a.e, i, ((sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS y FROM a{n} a JOIN parts v USING (r, p), range(1, 5) t(i) GROUP BY ALL),\n"
                f"b{n + 1} AS (SELECT b.p, b.e, coalesce(list(m.y ORDER BY m.i) FILTER (m.y IS NOT NULL), any_value(b.x)) AS x FROM b{n} b LEFT JOIN m{n} m USING (p, e) GROUP BY b.p, b.e),\n")

    body = "".join(assign(n) + update(n) for n in range(rounds)) + assign(rounds)
    return f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, q[4 * p + 1:4 * p + 4] AS x FROM kept, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 64),
{body}c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN c USING (r), h
"""
