"""Sequence packing: patterns of few lengths fitted to the length histogram.

The plan is made on the histogram of piece lengths, which has at most ``capacity``
entries however many pieces there are.  Lengths are grouped into bands; patterns
of one to four bands that fill a sequence are enumerated, a non-negative
least-squares fit says how often each is to be used, and the rounded-down counts
are drawn from the exact lengths.  What remains goes, longest first, into the
tightest sequence that has room, or into a new one.  A plan entry stands for any
number of equal sequences, so the plan stays small too.

Spark numbers the pieces of each length (per hash block, plus the counts of the
blocks before) and looks every number up in the plan's slot ranges.
"""

from __future__ import annotations

import bisect
import copy
import json
import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import resident, slices, stage
from mnemo.llm.tokens import ASCII_WORDS, LATIN_END, LATIN_WORDS

CAPACITY = 4096
SEPARATOR = 1
#: Beyond the Latin blocks the library's own lower-casing and letter classes are asked.
BEYOND_LATIN = re.compile(f"[{LATIN_END}-\U0010ffff]")
BANDS = 64
MEMO_ENTRIES = 500_000
#: Characters of the texts that are tokenised together.
SLICE_CHARS = 2_000_000
#: Pieces of a numbering block, on average.
BLOCK_PIECES = 10_000
#: Lengths whose patterns are fitted exactly: the most frequent ones, of so many pieces at least; tokens that such a pattern may waste.
EXACT_LENGTHS = 24
EXACT_COUNT = 32
EXACT_WASTE = 16


# ---- tokenising --------------------------------------------------------------

class PieceIds:
    """Ids of the library for words and space-free pieces of text, remembered as little-endian bytes.

    The memo has two generations: what is met again moves to the younger one, and when that is full, the older
    one, with what was not met since, is let go.  A new piece is cut into the words that the pre-tokenizer's pattern
    finds, and new words are encoded many at a time, joined by spaces: the last symbol of every word
    carries the vocabulary's end-of-word suffix.  Pieces with control or unusual characters, or
    that may hold a special string, are encoded by themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tok, suffix = Tokenizer.from_file(path), model.get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def spaced(text: str) -> str:
        """The text with spaces for line ends and tabs, lower-cased where that is what the library does."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "<" not in text and (text.isascii() or (not BEYOND_LATIN.search(text) and unicodedata.is_normalized("NFC", text))):
            text = text.lower()
        return text

    @staticmethod
    def words_of(piece: str) -> list[str] | None:
        """Pre-tokens of a piece, lower-cased; None for one that is to be encoded by itself."""
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            return ASCII_WORDS.findall(piece.lower()) if piece.isprintable() and "<" not in piece else None
        if not piece.isprintable() or "<" in piece or BEYOND_LATIN.search(piece) or not unicodedata.is_normalized("NFC", piece):
            return None
        return [piece.lower()] if piece.isalpha() else LATIN_WORDS.findall(piece.lower())

    def encode_each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return self.encode_each(words)
        data, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys that aren't remembered; what the older generation knows moves to the younger one."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def known(self, keys: list[str]) -> dict[str, bytes]:
        """A dict that holds the ids of all (distinct) ``keys``; valid until the next call."""
        if len(self.young) + len(keys) > MEMO_ENTRIES // 2:
            self.old, self.young = self.young, {}
        young, new = self.young, self.missing(keys)
        parts = list(map(self.words_of, new))
        words = self.missing({w for x in parts if x for w in x})
        for i in range(0, len(words), 4096):
            young.update(zip(words[i:i + 4096], self.encode_words(words[i:i + 4096])))
        alone = [p for p, x in zip(new, parts) if x is None]
        young.update(zip(alone, self.encode_each(alone)))
        get = young.__getitem__
        for p, x in zip(new, parts):
            if x is not None and p not in young:
                young[p] = b"".join(map(get, x))
        return young

    def ids(self, texts: list[str]) -> list[bytes]:
        """Pre-tokens never cross spaces or line ends, so the ids of the pieces in a row are the text's.

        Splitting, finding the distinct pieces and putting their ids in a row is done by Arrow for all texts at once.
        """
        parts = pc.split_pattern(pa.array([self.spaced(t) for t in texts], pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known(distinct)
        ids = pa.array([known[p] for p in distinct], pa.binary())
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids.take(coded.indices)), b"").to_pylist()


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: id, piece, start, length, ids_crc32."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = resident(("ids", tokenizer), lambda: PieceIds(tokenizer))
        end = np.array([SEPARATOR], "<u4").tobytes()
        for b in batches:
            out = []
            texts = b["text"].fillna("").tolist()
            for i, j in slices(texts, SLICE_CHARS):
                for doc, ids in zip(b["id"].iloc[i:j], known.ids(texts[i:j])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        x = ids[at:at + 4 * capacity]
                        out.append((doc, k, at // 4, len(x) // 4, zlib.crc32(x)))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long")


# ---- the plan, on the histogram ----------------------------------------------

def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by an active set: the column that helps most joins, columns that would turn negative leave."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        if gain.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[gain.argmax()] = True
        while True:
            cols = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            share = np.min(x[cols][low] / (x[cols][low] - z[low] + 1e-300))
            x[cols] += share * (z - x[cols])
            used[cols[(x[cols] <= 1e-12) & low]] = False
            x[~used] = 0
            if not used.any():
                return x
    return x


def band_patterns(bands: int, depth: int = 4, slack: int = 1) -> list[tuple[int, ...]]:
    """Falling band sizes (in units of capacity / bands) that fill a sequence but for ``slack`` units; four parts only with a large first."""
    out: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        if parts and left <= slack:
            out.append(parts)
        if len(parts) == depth or (len(parts) == depth - 1 and parts[0] < bands // 3):
            return
        for p in range(min(left, parts[-1] if parts else bands), 0, -1):
            if p * (depth - len(parts)) < left - slack:
                break
            grow((*parts, p), left - p)

    grow((), bands)
    return out


@dataclass
class Plan:
    """Groups of equal sequences: ``lengths[g]`` in each of ``copies[g]``; ``room`` finds groups by free space."""

    capacity: int
    lengths: list[tuple[int, ...]] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    room: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    free: list[int] = field(default_factory=list)

    def add(self, lengths: tuple[int, ...], copies: int) -> None:
        self.lengths.append(lengths)
        self.copies.append(copies)
        left = self.capacity - sum(lengths)
        if left:
            if not self.room[left]:
                bisect.insort(self.free, left)
            self.room[left].append(len(self.lengths) - 1)

    def place(self, length: int, count: int) -> None:
        """``count`` pieces of ``length``, each into the tightest sequence with room."""
        while count:
            at = bisect.bisect_left(self.free, length)
            if at == len(self.free):
                per = self.capacity // length
                if count >= per:
                    self.add((length,) * per, count // per)
                if count % per:
                    self.add((length,) * (count % per), 1)
                return
            left = self.free[at]
            g = self.room[left].pop()
            if not self.room[left]:
                self.free.pop(at)
            each = left // length
            full = min(self.copies[g], count // each)
            rest = self.copies[g] - full
            old = self.lengths[g]
            self.copies[g] = 0
            count -= full * each
            if full:
                self.add(old + (length,) * each, full)
            if rest and count and not full:
                self.add(old + (length,) * count, 1)
                rest, count = rest - 1, 0
            if rest:
                self.add(old, rest)


def exact_patterns(lengths: list[int], capacity: int, waste: int = EXACT_WASTE, depth: int = 4) -> list[tuple[int, ...]]:
    """Falling multisets of up to ``depth`` of the ``lengths`` that fill a sequence but for ``waste`` tokens."""
    out: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], at: int, left: int) -> None:
        if parts and left <= waste:
            out.append(parts)
        if len(parts) < depth:
            for i in range(at, len(lengths)):
                if lengths[i] <= left and lengths[i] * (depth - len(parts)) >= left - waste:
                    grow((*parts, lengths[i]), i, left - lengths[i])

    lengths = sorted(lengths, reverse=True)
    grow((), 0, capacity)
    return out


def uses_of(patterns: list[tuple[int, ...]], counts: dict[int, float], weight: dict[int, float]) -> list[tuple[tuple[int, ...], int]]:
    """How often each pattern is to be used, rounded down: the fit to the counts of its parts, long parts weighing more."""
    place = {x: i for i, x in enumerate(counts)}
    a = np.zeros((len(counts), len(patterns)))
    for j, p in enumerate(patterns):
        for x in p:
            a[place[x], j] += 1
    w = np.array([weight[x] for x in counts])
    uses = nnls(a * w[:, None], np.array(list(counts.values()), float) * w)
    return [(patterns[j], int(uses[j] + 1e-6)) for j in sorted(np.flatnonzero(uses >= 1 - 1e-6), key=lambda j: patterns[j], reverse=True)]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, bands: int = BANDS) -> Plan:
    """Pack ``histogram[length]`` pieces of every length.

    Patterns are fitted to the most frequent lengths as they are, or to bands of lengths alone; of these, and of a
    few bounds on the space that a pattern may waste, the best is taken.
    """
    frequent = sorted((x for x, n in histogram.items() if x < capacity and n >= EXACT_COUNT), key=lambda x: (-histogram[x], x))[:EXACT_LENGTHS]
    patterns = exact_patterns(frequent, capacity)
    exact = uses_of(patterns, {x: histogram[x] for x in frequent}, {x: math.sqrt(x / capacity) for x in frequent}) if patterns else []
    starts = [[], exact] if exact else [[]]
    return min((plan for start in starts for plan in banded_plans(histogram, capacity, bands, start)), key=lambda plan: sum(plan.copies))


def banded_plans(histogram: dict[int, int], capacity: int, bands: int, start: list[tuple[tuple[int, ...], int]]) -> Iterator[Plan]:
    """Plans that begin with the exact patterns ``start``, as far as there are pieces for them, and fit bands to the rest."""
    begun, left = Plan(capacity), dict(histogram)
    for pattern, times in start:
        run = min([times, *(left.get(x, 0) // pattern.count(x) for x in set(pattern))])
        if run:
            begun.add(pattern, run)
            for x in set(pattern):
                left[x] -= run * pattern.count(x)
    left = {x: n for x, n in left.items() if n}
    unit = max(1, capacity // bands)
    counts = np.zeros(bands + 2)
    for length, n in left.items():
        if length < capacity:
            counts[-(-length // unit)] += n
    # the lowest band stays out: its pieces fill what the patterns leave
    patterns = [p for p in band_patterns(bands) if p[-1] > 1 and all(counts[q] for q in p)]
    fitted = uses_of(patterns, dict(enumerate(counts)), {q: math.sqrt(q / bands) for q in range(bands + 2)}) if patterns else []
    for waste in (0, 1, 4):
        yield fill(copy.deepcopy(begun), left, capacity, unit, fitted, waste)


def fill(plan: Plan, histogram: dict[int, int], capacity: int, unit: int, fitted: list[tuple[tuple[int, ...], int]], waste: int) -> Plan:
    """Draw the patterns' counts from the exact lengths, then place what is left, longest first."""
    left = dict(histogram)
    if left.get(capacity):
        plan.add((capacity,), left.pop(capacity))
    lengths = sorted(left)
    for pattern, times in fitted:
        while times and (taken := drawn(pattern, left, lengths, capacity, unit, waste)):
            run = min([times, *(left[x] // taken.count(x) for x in set(taken))])
            plan.add(taken, run)
            times -= run
            for x in set(taken):
                left[x] -= run * taken.count(x)
                if not left[x]:
                    del left[x], lengths[bisect.bisect_left(lengths, x)]
    for length in reversed(lengths):
        plan.place(length, left[length])
    return plan


def drawn(pattern: tuple[int, ...], left: dict[int, int], lengths: list[int], capacity: int, unit: int, waste: int) -> tuple[int, ...] | None:
    """Exact lengths for one sequence: the longest of each band, and as the last part what fits best; None if too much stays free."""
    taken: list[int] = []
    room = capacity
    for i, band in enumerate(pattern):
        top = room if i == len(pattern) - 1 else min(band * unit, room)
        at = bisect.bisect_right(lengths, top) - 1
        while at >= 0 and left[lengths[at]] <= taken.count(lengths[at]):
            at -= 1
        if at < 0:
            return None
        taken.append(lengths[at])
        room -= lengths[at]
    return tuple(taken) if room <= waste else None


def slot_ranges(plan: Plan) -> pd.DataFrame:
    """Rows (length, first, sequence, offset): the pieces of ``length`` numbered from ``first`` on go, one each, into the sequences from ``sequence`` on."""
    rows, seen, sequence = [], defaultdict(int), 0
    for lengths, copies in zip(plan.lengths, plan.copies):
        offset = 0
        for x in lengths if copies else ():
            rows.append((x, seen[x], sequence, offset))
            seen[x] += copies
            offset += x
        sequence += copies
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"], dtype="int64").sort_values(["length", "first"])


# ---- the operator ------------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the plan finds.

    :param tokenizer: path of the tokenizers JSON file, readable on every executor.

    A document is its ids and a closing id 1; only longer ones are cut, into
    ``capacity`` ids and a rest.  Returns one row per piece: id, piece, start,
    length, ids_crc32, sequence_id, offset.  A null text is empty (one piece of
    length 1); repeated rows and ids are packed each for itself; an empty table
    gives an empty result; other columns are not read.

    To the driver go only the histogram and the plan; the plan's entries number
    at most a small multiple of ``capacity``.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    ranges = slot_ranges(make_plan(histogram, capacity))
    plan = spark.sparkContext.broadcast((ranges["length"].to_numpy(), ranges["first"].to_numpy(), ranges["sequence"].to_numpy(), ranges["offset"].to_numpy()))

    # number the pieces of a length: within blocks of about equal size, after those of the blocks before; which block
    # a piece is in follows from its row, so equal pieces are spread too
    blocks = spark.createDataFrame([(x, -(-n // BLOCK_PIECES)) for x, n in histogram.items()], "length long, blocks long")
    dealt = cut.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).drop("blocks")
    sizes = dealt.groupBy("length", "block").count()
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"), "block-sizes")
    order = Window.partitionBy("length", "block").orderBy("row")
    numbered = (dealt.withColumn("place", F.row_number().over(order) - 1)
                .join(sizes, ["length", "block"]).withColumn("place", F.col("place") + F.col("before")).drop("block", "before"))

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, sequence, offset = plan.value
        wide = length * (1 << 45) + first
        for b in batches:
            n = b["length"].to_numpy()
            at = np.searchsorted(wide, n * (1 << 45) + b["place"].to_numpy(), side="right") - 1
            assert (length[at] == n).all()
            yield b.drop(columns="place").assign(sequence_id=sequence[at] + b["place"].to_numpy() - first[at], offset=offset[at])

    seated = numbered.select("id", "piece", "start", "length", "ids_crc32", "place").mapInPandas(
        seat, "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return seated.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
