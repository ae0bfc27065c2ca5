"""Token counts by byte-pair merging over a heap and a linked list.

A text's count is the number of initial symbols (bytes) of its pre-tokens minus
the number of merges made; no token id is produced.  Pre-tokens never cross
spaces, so a text is cut at ASCII spaces and line ends and every distinct piece
is counted once per worker (a bounded memo that is emptied when full).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import resident

MEMO_ENTRIES = 500_000
#: Up to here (Latin blocks) str.lower and the letter classes agree with the library's; beyond, the library itself is asked.
LATIN_END = "\u0250"
# the pre-tokenizer's pattern, for ASCII and for the Latin blocks (fixed values)
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\t\n\x0b\x0c\r ]+")
LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte value in a byte-level vocabulary: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PairMerger:
    """Merge ranks of a tokenizers JSON file (byte-level BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.byte_id, self.last_id = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        #: left id, right id -> rank and id of the merged symbol, both above the 32 bits of a position
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = (vocab[a] << 20) | vocab[b]
            if key not in self.pairs:
                self.pairs[key] = ((rank + 1) << 52) | (vocab[a + b] << 32)
        tok = Tokenizer.from_file(path)
        self.normalize, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        # special strings are recognised in the raw text; the longest wins where two begin together
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {"": 0}

    def count_word(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        get = self.pairs.get
        ids = list(map(self.byte_id.__getitem__, word))
        ids[-1] = self.last_id[word[-1]]
        left = n = len(ids)
        if n == 1:
            return 1
        heap = [v | i for i in range(n - 1) if (v := get((ids[i] << 20) | ids[i + 1]))]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            # stale: the symbol is gone, at the end, or its pair has changed since
            if ids[i] < 0 or j >= n or get((ids[i] << 20) | ids[j]) != top - i:
                continue
            ids[i] = new = (top >> 32) & 0xFFFFF
            ids[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if v := get((new << 20) | ids[k]):
                    heappush(heap, v | i)
            h = before[i]
            if h >= 0 and (v := get((ids[h] << 20) | new)):
                heappush(heap, v | h)
        return left

    def count_plain(self, piece: str) -> int:
        if piece.isascii() and piece.isprintable():
            words = [w.encode() for w in ASCII_WORDS.findall(piece.lower())]
        elif piece.isprintable() and max(piece) < LATIN_END and unicodedata.is_normalized("NFC", piece):
            words = [w.encode() for w in LATIN_WORDS.findall(piece.lower())]
        else:
            words = [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.split(self.normalize(piece))]
        total, known = 0, self.words
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= MEMO_ENTRIES:
                    known.clear()
                n = known[w] = self.count_word(w)
            total += n
        return total

    def count_piece(self, piece: str) -> int:
        if self.special is None or "<" not in piece:
            return self.count_plain(piece)
        plain = self.special.split(piece)
        return len(plain) - 1 + sum(map(self.count_plain, plain))

    def count(self, text: str) -> int:
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        memo = self.pieces
        for p in set(parts).difference(memo):
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
                return sum(map(self.count_piece, parts))
            memo[p] = self.count_piece(p)
        return sum(map(memo.__getitem__, parts))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text.

    :param tokenizer: path of the tokenizers JSON file, readable on every executor.
    :param limit: ``over_limit`` is true above so many tokens.

    One row per input row, repeated ids included.  A null text counts as empty
    (0 bytes, 0 tokens); a null id is passed on; other columns are not read; an
    empty table gives an empty result.  Texts are counted whole, whatever their length.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = resident(("merges", tokenizer), lambda: PairMerger(tokenizer))
        for b in batches:
            texts = b["text"].fillna("")
            yield pd.DataFrame({"id": b["id"], "n_bytes": [len(t.encode()) for t in texts],
                                "n_tokens": [m.count(t) for t in texts]})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "id string, n_bytes long, n_tokens long").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
