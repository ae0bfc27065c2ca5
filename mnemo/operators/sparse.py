"""BM25-style sparse similarity in long form.

Every table is ``(corpus keys..., doc, term, value)``; nothing is densified.
A *corpus* is identified by ``keys`` (e.g. ``["request_id"]`` when each request
fits its own vocabulary on its candidate set); ``keys=[]`` is one global corpus.

Weights (fitted per corpus, k1 = 1.5, b = 0.75):

* ``idf = ln(N / df) + 1`` (no smoothing)
* document: ``x = tf * idf``, ``L = sum x``, ``avg = mean L`` (empty documents count),
  ``w = x * idf * (k1 + 1) / (x * k1 * (1 - b + b * L / avg) + 1)``
* query: ``u = tf * idf**2``, ``v = u * (k1 + 1) / (u + k1)`` (unknown terms vanish)
* similarity: cosine of v and w, 0 when either side is empty.

Many small corpora (one per request, bounded by the candidate limit) are fitted and asked
one by one inside tasks, on arrays of token hashes: a document is sent once to each block of
requests, and no row per corpus and term is ever made.  The global corpus uses grouped aggregates and scalar
subqueries instead of a key-less window (which would pull everything into one task).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import materialize
from ..schema import BM25_B, BM25_K1


#: Documents whose tokens are counted together.
DOCS_AT_ONCE = 4096
#: Scored rows that a task hands over at once.
ROWS_OUT = 32768


def term_counts(df: DataFrame, id_cols: list[str], text_col: str, tokenizer=tokenize) -> DataFrame:
    """(id_cols..., term, tf) for every token of ``text_col``."""
    exploded = df.select(*id_cols, F.explode(tokenizer(F.col(text_col))).alias("term"))
    return exploded.groupBy(*id_cols, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


@dataclass
class BM25Model:
    keys: list[str]
    doc_col: str
    idf: DataFrame          # (keys..., term, idf)
    weights: DataFrame      # (keys..., doc, term, idf, w)
    norms: DataFrame        # (keys..., doc, dn)
    docs: DataFrame         # (keys..., doc)
    k1: float = BM25_K1
    b: float = BM25_B


def bm25_fit(docs: DataFrame, keys: list[str], doc_col: str, text_col: str,
             k1: float = BM25_K1, b: float = BM25_B, tokenizer=tokenize) -> BM25Model:
    """Fit BM25 statistics on ``docs(doc_col, text_col)``, one global corpus (``keys`` empty)."""
    if keys:
        raise ValueError("a corpus per key is fitted and queried in one pass: keyed_bm25_scores")
    return bm25_from_counts(term_counts(docs, [doc_col], text_col, tokenizer), docs.select(doc_col), doc_col, k1, b)


def _doc_weight(x: Column, idf: Column, length: Column, avgdl: Column, k1: float, b: float) -> Column:
    return x * idf * (k1 + 1.0) / (x * (k1 * (1.0 - b + b * length / avgdl)) + 1.0)


def corpus_stats(docs: DataFrame, doc_col: str, text_col: str, tokenizer=tokenize) -> DataFrame:
    """``(term, df, idf)`` of one global corpus, ``idf = ln(N / df) + 1``."""
    n_docs = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    return (term_counts(docs, [doc_col], text_col, tokenizer).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .select("term", "df", (F.log(n_docs / F.col("df")) + 1.0).alias("idf")))


def bm25_from_counts(tf: DataFrame, docs: DataFrame, doc_col: str, k1: float = BM25_K1, b: float = BM25_B, written: bool = False) -> BM25Model:
    """The global model from term counts ``tf(doc, term, tf)`` of all ``docs(doc)``.  The counts are written once, unless they are
    ``written`` already; all statistics are aggregates of them."""
    tf = tf if written else materialize(tf)
    n_docs = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    idf = tf.groupBy("term").agg((F.log(n_docs / F.count(F.lit(1))) + 1.0).alias("idf"))
    x = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    lengths = x.groupBy(doc_col).agg(F.sum("x").alias("len"))
    avgdl = x.agg(F.sum("x")).scalar() / n_docs
    weights = x.join(lengths, doc_col).select(
        doc_col, "term", "idf", _doc_weight(F.col("x"), F.col("idf"), F.col("len"), avgdl, k1, b).alias("w"))
    norms = weights.groupBy(doc_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    return BM25Model([], doc_col, idf, weights, norms, docs.select(doc_col), k1, b)


def from_documents(docs: DataFrame, doc_col: str, text_col: str, tokenizer=tokenize) -> DataFrame:
    """``(doc, term, v)``: a model fitted on the documents, and the documents as its query vectors."""
    counts = materialize(term_counts(docs, [doc_col], text_col, tokenizer))
    model = bm25_from_counts(counts, docs, doc_col, written=True)
    return counts.join(model.idf, "term").select(doc_col, "term", _query_weight(F.col("tf"), F.col("idf"), model.k1).alias("v"))


def _query_weight(tf: Column, idf: Column, k1: float) -> Column:
    u = tf * idf * idf
    return u * (k1 + 1.0) / (u + k1)


def bm25_transform(model: BM25Model, texts: DataFrame, qid_cols: list[str], text_col: str,
                   tokenizer=tokenize) -> DataFrame:
    """Query-side weights ``(keys..., qid..., term, v)``; out-of-vocabulary terms vanish."""
    qt = term_counts(texts, model.keys + qid_cols, text_col, tokenizer)
    return qt.join(model.idf, model.keys + ["term"]).select(
        *model.keys, *qid_cols, "term", _query_weight(F.col("tf"), F.col("idf"), model.k1).alias("v"))


def bm25_query(model: BM25Model, texts: DataFrame, qid_cols: list[str], text_col: str,
               tokenizer=tokenize, broadcast_query: bool = False) -> DataFrame:
    """Cosine similarity ``(keys..., qid..., doc, sim)`` for pairs sharing a term.

    Pairs without a shared term have similarity 0 and are not emitted (the matrix
    stays sparse).  ``broadcast_query`` marks the query-term side for broadcast
    (pass it only after checking the size of ``texts``).
    """
    keys, doc = model.keys, model.doc_col
    dot = sparse_dot(model, texts, qid_cols, text_col, tokenizer, broadcast_query, with_norm=True)
    return (dot.join(model.norms, keys + [doc])
            .select(*keys, *qid_cols, doc,
                    F.coalesce(F.try_divide(F.col("dot"), F.col("qn") * F.col("dn")), F.lit(0.0)).alias("sim")))


def hashed_tokens(text: Column, tokenizer=tokenize) -> Column:
    """The tokens of a text as 64-bit hashes, repetitions included (null text: none)."""
    return F.transform(F.coalesce(tokenizer(text), F.array().cast("array<string>")), lambda t: F.xxhash64(t))


class TermRows:
    """Term counts of documents, which are added some at a time: those of document ``i`` are ``terms[start[i]:start[i + 1]]`` and ``tf``.

    A term is the number of its hash, ``numbers`` of the sorted ``hashes``.  ``counts_of`` and ``v`` have a place per number, for the
    scoring of one corpus after the other; they are 0 in between.
    """

    def __init__(self) -> None:
        self.sizes, self.start = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
        self.terms, self.tf = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.hashes, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.counts, self.v = {}, np.zeros(0)

    def add(self, start: np.ndarray, tokens: np.ndarray) -> None:
        """Documents whose token hashes are ``tokens[start[i]:start[i + 1]]``."""
        n = len(start) - 1
        for a in range(0, n, DOCS_AT_ONCE):
            b = min(n, a + DOCS_AT_ONCE)
            at, terms = pd.factorize(tokens[start[a]:start[b]], sort=True)
            owner = np.repeat(np.arange(b - a), np.diff(start[a:b + 1]))
            pairs, tf = np.unique(owner * max(len(terms), 1) + at, return_counts=True)
            self.sizes.append(np.bincount(pairs // max(len(terms), 1), minlength=b - a))
            if len(tf) and tf.max() > np.iinfo(self.tf.dtype).max:
                self.tf = self.tf.astype(np.int32)
            end = len(self.terms)
            for held in (self.terms, self.tf):  # grown in place
                held.resize(end + len(pairs), refcheck=False)
            self.terms[end:], self.tf[end:] = self._numbered(terms)[pairs % max(len(terms), 1)], tf

    def add_counts(self, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, hashes: np.ndarray) -> None:
        """Documents of ``sizes`` distinct terms; ``terms`` are places of the sorted ``hashes``."""
        used = np.zeros(len(hashes), bool)
        used[terms] = True
        number = np.zeros(len(hashes), np.int32)
        number[used] = self._numbered(hashes[used])
        self.sizes.append(sizes)
        if len(tf) and tf.dtype != self.tf.dtype and tf.max() > np.iinfo(self.tf.dtype).max:
            self.tf = self.tf.astype(np.int32)
        end = len(self.terms)
        for held in (self.terms, self.tf):  # grown in place
            held.resize(end + len(terms), refcheck=False)
        self.terms[end:], self.tf[end:] = number[terms], tf

    def _numbered(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of sorted hashes; new ones get the next numbers."""
        place = np.searchsorted(self.hashes, terms)
        new = np.r_[self.hashes, 0][place] != terms
        new |= place == len(self.hashes)
        fresh = np.arange(len(self.hashes), len(self.hashes) + new.sum(), dtype=np.int32)
        self.numbers = np.insert(self.numbers, place[new], fresh)
        self.hashes = np.insert(self.hashes, place[new], terms[new])
        return self.numbers[np.searchsorted(self.hashes, terms)]

    def close(self) -> None:
        """After the last documents, before the first scores."""
        self.start = np.cumsum(np.concatenate(self.sizes))
        self.counts, self.v = {}, np.zeros(len(self.hashes))

    def counts_of(self, n: int) -> tuple[np.ndarray, int]:
        """A place per number for counts up to ``n``, in the smallest type, as they are read in any order; and a bit above them."""
        kind = np.uint16 if n < 1 << 15 else np.uint32
        if kind not in self.counts:
            self.counts[kind] = np.zeros(len(self.hashes), kind)
        return self.counts[kind], 1 << (8 * self.counts[kind].itemsize - 1)


def term_rows(start: np.ndarray, tokens: np.ndarray) -> TermRows:
    """The counts of documents whose token hashes are ``tokens[start[i]:start[i + 1]]``."""
    table = TermRows()
    table.add(start, tokens)
    table.close()
    return table


def spans(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``start[r]`` to ``start[r + 1]`` of every row, and which of ``rows`` they belong to."""
    size = start[rows + 1] - start[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[rows][owner], owner


def rows_scores(table: TermRows, rows: np.ndarray, texts: list[np.ndarray], weights: list[float], k1: float = BM25_K1, b: float = BM25_B,
                factors: np.ndarray | None = None, top_n: int = 0) -> np.ndarray:
    """Per document of the corpus of ``rows`` the best of ``weight * similarity`` over the query texts (0 at least).

    With ``factors`` (0 at least, one per row) only what can be among the ``top_n`` largest products of factor and similarity is sure to
    be scored; other documents may be given 0.  The model is fitted on all documents in any case.
    """
    n, best = len(rows), np.zeros(len(rows))
    sizes = table.start[rows + 1] - table.start[rows]
    start = np.r_[0, np.cumsum(sizes)]
    if not start[-1]:
        return best
    at = np.arange(start[-1]) + np.repeat(table.start[rows] - start[:-1], sizes)
    t, v, (df, asked_bit) = table.terms[at], table.v, table.counts_of(n)
    ordered = np.sort(t)
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    met, by_df = ordered[cuts[:-1]], np.log(n / np.arange(1, n + 1)) + 1.0
    df[met] = np.diff(cuts)
    by_df = np.r_[0.0, by_df]
    asked = []
    for text, weight in zip(texts, weights):
        hashes, qtf = np.unique(text, return_counts=True)
        place = np.minimum(np.searchsorted(table.hashes, hashes), len(table.hashes) - 1)
        found, place = table.hashes[place] == hashes, table.numbers[place]
        known = found & (df[place] > 0)
        place = place[known]
        asked.append((place, qtf[known] * by_df[df[place]] ** 2, weight))
    for place, *_ in asked:
        df[place] |= asked_bit
    asked = [(place, value, np.sqrt((value ** 2).sum()), weight) for place, u, weight in asked for value in [u * (k1 + 1.0) / (u + k1)]]
    of_term = df[t]
    df[met] = 0
    shared = of_term >= asked_bit  # the only terms that any text has
    of_term &= df.dtype.type(asked_bit - 1)
    idf = by_df[of_term]
    x = table.tf[at] * idf
    filled, length = np.flatnonzero(sizes), np.zeros(n)
    length[filled] = np.add.reduceat(x, start[filled])
    slope = k1 * (1.0 - b + b * length / (length.sum() / n))

    def score(docs: np.ndarray) -> None:
        of, owner = spans(start, docs)
        xs = x[of]
        w = xs * idf[of] * (k1 + 1.0) / (xs * slope[docs][owner] + 1.0)
        norm = np.sqrt(np.bincount(owner, w * w, len(docs)))
        some = np.flatnonzero(shared[of])
        ts, ws, owner = t[of[some]], w[some], owner[some]
        for place, value, size, weight in asked:
            v[place] = value
            scale = norm * size
            dot = np.bincount(owner, ws * v[ts], len(docs))
            v[place] = 0.0
            best[docs] = np.maximum(best[docs], weight * np.divide(dot, scale, out=np.zeros(len(docs)), where=scale > 0))

    if factors is None or top_n < 1 or not np.isfinite(factors).all() or (factors < 0).any() or not np.isfinite(weights).all() or n <= 4 * top_n:
        score(np.arange(n))
    else:
        # a similarity is at most the share of the query's length that the shared terms have
        some = np.flatnonzero(shared)
        ts, ds, most = t[some], np.searchsorted(start, some, side="right") - 1, np.zeros(n)
        for place, value, size, weight in asked:
            v[place] = value
            most = np.maximum(most, weight * np.sqrt(np.bincount(ds, v[ts] ** 2, n)) / (size or 1.0))
            v[place] = 0.0
        most *= factors
        order = np.argsort(-most, kind="stable")
        first = order[:4 * top_n]
        score(np.sort(first))
        last = np.sort(best[first] * factors[first])[-top_n]
        score(np.sort(order[4 * top_n:][most[order[4 * top_n:]] >= max(last * (1.0 - 1e-6), np.nextafter(0.0, 1.0))]))
    return best


def corpus_scores(docs: list[np.ndarray], texts: list[np.ndarray], weights: list[float], k1: float = BM25_K1, b: float = BM25_B) -> np.ndarray:
    """Per document of one small corpus the best of ``weight * similarity`` over the query texts (0 at least).

    Documents and texts are arrays of token hashes.  The model is fitted on these documents alone.
    """
    tokens = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    table = term_rows(np.r_[0, np.cumsum([len(d) for d in docs], dtype=np.int64)], tokens)
    return rows_scores(table, np.arange(len(docs)), texts, weights, k1, b)


def best_corpus_scores(members: DataFrame, texts: DataFrame, key: str, doc_col: str, num_partitions: int) -> DataFrame:
    """``(key, doc, best_sim)``: a corpus per ``key``, asked with the texts of that key.

    ``members(key, doc, tokens)`` and ``texts(key, weight, tokens)`` with ``hashed_tokens``.  A document in several corpora
    is tokenized once; a corpus, which its caller bounds (the memory query by its candidate limit), is
    scored as a whole in one task.  Two terms of a corpus of 100,000 terms share a hash with a probability of
    3e-10; they would count as one.
    """
    def score(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        sims = corpus_scores(docs["tokens"].tolist(), asked["tokens"].tolist(), asked["weight"].tolist())
        # the same types for an empty side as for any other
        return pd.DataFrame({key: docs[key].astype(object), doc_col: docs[doc_col].astype(object), "best_sim": sims.astype(float)})

    left = members.select(key, doc_col, "tokens").repartition(num_partitions, key).groupBy(key)
    right = texts.select(key, "weight", "tokens").repartition(num_partitions, key).groupBy(key)
    return left.cogroup(right).applyInPandas(score, f"{key} string, {doc_col} string, best_sim double")


def list_values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of arrays."""
    lists = column.combine_chunks()
    return np.asarray(lists.offsets.to_numpy(), dtype=np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False)


class Block:
    """The documents of a block and the texts of its requests, taken in as they come."""

    def __init__(self, attributes: list[str]):
        self.attributes, self.parts, self.docs, self.texts = attributes, [], None, {}
        self.table = TermRows()

    def add(self, docs: pa.Table) -> None:
        """Documents ``(doc_id, tokens, attributes...)``."""
        self.table.add(*list_values(docs["tokens"]))
        # a copy, as the rows of a batch share its memory with their tokens
        self.parts.append(docs.select(["doc_id", *self.attributes]).take(pa.array(np.arange(len(docs)))))

    def close(self) -> None:
        """After the last documents, before the first request."""
        if self.docs is None and self.parts:
            self.table.close()
            self.docs, self.parts = pa.concat_tables(self.parts).combine_chunks(), []
            self.codes, self.names = pd.Index(self.docs["doc_id"].to_numpy()).factorize()
            self.by_code = np.argsort(self.codes, kind="stable")
            self.start = np.searchsorted(self.codes[self.by_code], np.arange(len(self.names) + 1))

    def scores(self, asked: pa.Table) -> Iterator[pa.Table]:
        """The candidates of requests with their distances, attributes and best similarities.

        ``asked``: rows ``(_request, _weight, tokens)`` with a request's texts, and, after these, a row ``(_request, _docs,
        _distances)`` with its candidates.  As in joins by ``doc_id``, a candidate that comes c times, of a document that comes t
        times, is c * t documents of its corpus, each of them scored, and c * t rows for each of these scores.
        """
        is_text = asked["_docs"].is_null().to_numpy()
        text_rows = asked.filter(pa.array(is_text))
        text_start, text_tokens = list_values(text_rows["tokens"])
        for i, (request, weight) in enumerate(zip(text_rows["_request"].to_pylist(), text_rows["_weight"].to_numpy())):
            self.texts.setdefault(request, []).append((weight, text_tokens[text_start[i]:text_start[i + 1]].copy()))
        self.close()
        if self.docs is None:
            return
        with_docs = asked.filter(pa.array(~is_text))
        lists = with_docs["_docs"].combine_chunks()
        first, doc_ids = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten()
        distances = list_values(with_docs["_distances"])[1]
        for i, request in enumerate(with_docs["_request"].to_pylist()):
            of_request = np.arange(first[i], first[i + 1])
            asked_codes = self.names.get_indexer(doc_ids.slice(first[i], len(of_request)).to_numpy(zero_copy_only=False))
            of_request, asked_codes = of_request[asked_codes >= 0], asked_codes[asked_codes >= 0]
            at, owner = spans(self.start, asked_codes)
            rows, cand = self.by_code[at], of_request[owner]
            held = self.texts.pop(request, [])
            best = rows_scores(self.table, rows, [t for _, t in held], [w for w, _ in held])
            if len(rows) > len(np.unique(self.codes[rows])):
                order = np.argsort(self.codes[rows], kind="stable")
                bounds = np.searchsorted(self.codes[rows][order], np.arange(len(self.names) + 1))
                every, again = spans(bounds, self.codes[rows])
                rows, cand, best = rows[again], cand[again], best[order[every]]
            of_docs = self.docs.take(pa.array(rows))
            yield pa.table({"request_id": pa.array([request] * len(rows), pa.string()), "doc_id": of_docs["doc_id"], "distance": pa.array(distances[cand], pa.float64()),
                            **{c: of_docs[c] for c in self.attributes}, "best_sim": pa.array(best, pa.float64())})


def _score_blocks(attributes: list[str]):
    """Rows sorted by block, its documents first, then request by request."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, out = Block(attributes), None, []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            blocks, is_doc = rows["_block"].to_numpy(), rows["_request"].is_null().to_numpy()
            cuts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (is_doc[1:] != is_doc[:-1])][:len(blocks)])
            for a, z in zip(cuts, np.r_[cuts[1:], len(blocks)]):
                if blocks[a] != number:
                    block, number = Block(attributes), blocks[a]
                part = rows.slice(a, z - a)
                if is_doc[a]:
                    block.add(part)
                    continue
                for scored in block.scores(part):
                    out.append(scored)
                    if sum(map(len, out)) >= ROWS_OUT:
                        yield from pa.concat_tables(out).combine_chunks().to_batches()
                        out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def candidate_scores(cands: DataFrame, docs: DataFrame, texts: DataFrame, num_blocks: int) -> DataFrame:
    """``(request_id, doc_id, distance, docs' other columns..., best_sim)``: a corpus per request, asked with the request's texts.

    ``cands(request_id, doc_id, distance)``, ``docs(doc_id, tokens, ...)`` and ``texts(request_id, weight, tokens)`` with
    ``hashed_tokens``.  Requests are dealt into blocks, a task each, and a document goes to a block once, for all its requests.
    A task holds the term counts of its block's documents, about 5 bytes a distinct term of each, and takes one request after the other.
    A request's candidates, bounded by the caller, are scored as one corpus.  Two terms of a corpus of 100,000 terms share a
    hash with a probability of 3e-10; they would count as one.
    """
    block = F.pmod(F.xxhash64("request_id"), F.lit(num_blocks)).cast("int").alias("_block")
    held = cands.where("request_id IS NOT NULL AND doc_id IS NOT NULL").select(block, "request_id", "doc_id", "distance")
    packed = held.groupBy("_block", "request_id").agg(F.collect_list(F.struct("doc_id", "distance")).alias("c")).select(
        "_block", F.col("request_id").alias("_request"), F.col("c.doc_id").alias("_docs"), F.col("c.distance").alias("_distances"))
    told = texts.where("request_id IS NOT NULL").select(block, F.col("request_id").alias("_request"), F.col("weight").alias("_weight"), "tokens")
    wanted = docs.join(held.select("_block", "doc_id").distinct(), "doc_id")
    attributes = [c for c in docs.columns if c not in ("doc_id", "tokens")]
    types = dict(docs.dtypes)
    schema = "request_id string, doc_id string, distance double, " + "".join(f"{c} {types[c]}, " for c in attributes) + "best_sim double"
    rows = wanted.unionByName(told, allowMissingColumns=True).unionByName(packed, allowMissingColumns=True).select(
        "_block", "_request", "_docs", "_distances", "_weight", "doc_id", "tokens", *attributes)
    return (rows.repartitionById(num_blocks, "_block").sortWithinPartitions("_block", F.col("_request").asc_nulls_first(), F.col("_docs").isNotNull())
            .mapInArrow(_score_blocks(attributes), schema))


def sparse_dot(model: BM25Model, texts: DataFrame, qid_cols: list[str], text_col: str,
               tokenizer=tokenize, broadcast_query: bool = False, with_norm: bool = False) -> DataFrame:
    """``(keys..., qid..., doc, dot[, qn])``: query weights . document weights over shared terms."""
    keys, doc = model.keys, model.doc_col
    qt = term_counts(texts, keys + qid_cols, text_col, tokenizer).withColumnRenamed("tf", "qtf")
    qside = F.broadcast(qt) if broadcast_query else qt
    joined = (model.weights.join(qside, keys + ["term"])
              .withColumn("v", _query_weight(F.col("qtf"), F.col("idf"), model.k1)))
    dot = joined.groupBy(*keys, *qid_cols, doc).agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    if not with_norm:
        return dot
    qn = (joined.groupBy(*keys, *qid_cols, "term").agg(F.first("v").alias("v"))
          .groupBy(*keys, *qid_cols).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("qn")))
    return dot.join(qn, keys + qid_cols)


def vocabulary(idf: DataFrame) -> DataFrame:
    """``(term, feature_index)``: sorted distinct terms numbered from 0.

    Dense numbering without a single-task window: the terms are dealt into ranges of
    about equal size, numbered inside them, and shifted by the counts of the ranges
    before (a window over one row per range).
    """
    terms = idf.select("term").distinct().repartitionByRange("term")
    dealt = materialize(terms.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("term"))
    return (dealt.withColumn("_place", place).join(F.broadcast(starts), "_range")
            .select("term", (F.col("_start") + F.col("_place") - 1).cast("long").alias("feature_index")))
