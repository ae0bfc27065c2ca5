"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become byte strings of their words, one space before, between and after
them, so a window of words is one byte pattern that begins and ends with a
space.  All windows of the benchmark are searched at once: a table of byte
blocks says how far the search may jump, the block at a window's end selects
the few patterns that can stand there, and a direct comparison decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import resident, stage

#: Bytes of benchmark text that are searched for in one pass over the documents.
BLOCK_BYTES = 8 << 20
#: Patterns below this length get tables of their own, so that they don't shorten the jumps for all others.
SHORT_BYTES = 24

# A-Z to a-z; every other ASCII byte that is no digit or letter to a space; bytes from 128 on stay (they belong to words)
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


class BlockTables:
    """Shift table and suffix buckets for patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.width = width = max(1, min(10, m // 2))
        self.jump = m - width + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(width, m + 1):
                block = p[end - width:end]
                if self.shift.get(block, self.jump) > m - end:
                    self.shift[block] = m - end
            self.bucket.setdefault(p[m - width:m], []).append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Start and pattern of every occurrence."""
        shift, jump, width, m, size = self.shift.get, self.jump, self.width, self.m, len(text)
        end = m
        while end <= size:
            step = shift(text[end - width:end], jump)
            if step:
                end += step
                continue
            for p in self.bucket[text[end - width:end]]:
                if text.startswith(p, end - m):
                    yield end - m, p
            end += 1


class WindowSearch:
    """Finds the word windows of a set of (item id, text) rows."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.owners: dict[bytes, set[str]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - n + 1) if words else 0):
                self.owners.setdefault(joined(words[i:i + n]), set()).add(item)
        sizes = ([p for p in self.owners if len(p) < SHORT_BYTES], [p for p in self.owners if len(p) >= SHORT_BYTES])
        self.tables = [BlockTables(p) for p in sizes if p]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of the occurrences and the items that they belong to."""
        text = joined(words)
        spans, items, gaps = [], set(), None
        for t in self.tables:
            for start, p in t.find(text):
                if gaps is None:
                    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                first = int(np.searchsorted(gaps, start))
                spans.append((first, first + p.count(b" ") - 1))
                items |= self.owners[p]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def search_pass(rows: DataFrame, items: list[tuple[str, str]], n: int, with_text: bool) -> DataFrame:
    """Adds the occurrences of one block of items to ``hit_starts``, ``hit_ends`` and ``items``; ``with_text`` keeps text and rest."""
    block, key = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    kinds = {"n_words": pa.int64(), "hit_starts": pa.list_(pa.int32()), "hit_ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
    passed = ["id", "text", "rest"] if with_text else ["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = resident(("windows", key), lambda: WindowSearch(block.value, n))
        for b in batches:
            out = {k: [] for k in kinds}
            for text, starts, ends, known in zip(*(b.column(c).to_pylist() for c in ("text", "hit_starts", "hit_ends", "items"))):
                words = words_of(text or "")
                spans, found = search.hits(words)
                spans = merged([*zip(starts, ends), *spans])
                for k, v in zip(kinds, (len(words), [x for x, _ in spans], [x for _, x in spans], sorted({*known, *found}))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), *(pa.array(out[k], t) for k, t in kinds.items())], names=[*passed, *kinds])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in [*passed, *kinds]]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Every occurrence of a window of ``n`` benchmark words in the documents.

    Words are runs of ASCII letters and digits and of any non-ASCII characters,
    A-Z lower-cased.  An item of fewer than ``n`` words, but not none, is one window.
    The benchmark is searched for in blocks of about ``block_bytes``, chosen by a
    hash of the item, so no broadcast grows with it.

    Returns one row per document row: id, the text and the columns of ``keep`` if any are named, ``n_words``, ``n_hit`` (words inside any
    occurrence), ``hit_starts`` / ``hit_ends`` (disjoint word spans, end exclusive),
    ``items`` (ids as strings, sorted as strings), ``n_items`` and ``contaminated``.
    A null or empty text has no words and no hits; items without id, text or words
    take no part; repeated rows on either side give repeated documents and the same
    item once; empty tables give no rows or no hits; columns not named are not read.
    """
    items = (benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("words")))
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    none = F.array().cast("array<int>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       (F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")).alias("rest"), F.lit(0).cast("long").alias("n_words"),
                       none.alias("hit_starts"), none.alias("hit_ends"), F.array().cast("array<string>").alias("items"))
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i).collect()
        rows = search_pass(stage(rows, "decontaminate") if i else rows, [tuple(r) for r in part], n, bool(keep) or i < blocks - 1)
    covered = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: e - s), F.lit(0), lambda a, x: a + x)
    kept = [F.col("text").alias(text_col), *[F.col("rest")[c].alias(c) for c in keep]] if keep else []
    return rows.select(F.col("id").alias(id_col), *kept, "n_words", covered.cast("long").alias("n_hit"), "hit_starts", "hit_ends", "items",
                       F.size("items").cast("long").alias("n_items"), (F.size("hit_starts") > 0).alias("contaminated"))


DECONTAMINATE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
k AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM k),
d AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n),
o AS (SELECT doc_id, i, d.n, item_id FROM d JOIN p ON d.n = p.n AND array_to_string(ws[i:i + d.n - 1], ' ') = win),
h AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM o) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
