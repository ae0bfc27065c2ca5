"""The n most similar documents of every query, exactly, without scoring all pairs that share a term.

Vectors have unit length and positive weights.  Of every term the postings with the
largest weights (its head) are looked at first: they give partial scores, whose n-th
largest is a bound that the n-th score cannot fall below, and the weight after the head bounds
all postings behind it.  Taken from the smallest contribution on, as many of a query's terms as
cannot reach that bound together are not essential: a document that has only such terms
behind their heads is out.  So frequent words, whose postings are the long ones and weigh
little, are never read as a whole: candidates come from the heads and from the
postings of essential terms, those that the bounds rule out go, and the rest is scored in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import materialize
from .sparse import BM25Model, bm25_fit, bm25_transform

#: Postings in a term's head, at least n of them.
HEAD_POSTINGS = 64
#: Query terms broadcast at most (a term of a query each).
MAX_BROADCAST_TERMS = 1_000_000
#: Scores are compared at this many places, so that sums taken in another order tie alike.
SCORE_PLACES = 9
#: Relative slack of the bounds against rounding.
SLACK = 1e-9


def unit_vectors(model: BM25Model) -> DataFrame:
    """``(doc, term, u)``: the fitted documents' weights at unit length (one global corpus)."""
    return (model.weights.select(model.doc_col, "term", "w").join(model.norms, model.doc_col).where("dn > 0")
            .select(model.doc_col, "term", (F.col("w") / F.col("dn")).alias("u")))


def unit_queries(model: BM25Model, texts: DataFrame, qid: str, text_col: str, tokenizer=tokenize) -> DataFrame:
    """``(qid, term, v)``: query weights at unit length; unknown terms vanish, and queries without others."""
    v = bm25_transform(model, texts, [qid], text_col, tokenizer)
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(qid)))  # a query's own terms
    return v.withColumn("qn", norm).where("qn > 0").select(qid, "term", (F.col("v") / F.col("qn")).alias("v"))


def ranked(scores: DataFrame, qid: str, doc: str, n: int | None) -> DataFrame:
    """``(qid, doc, sim, rank)``: ranked by the rounded score, ties by document, down to ``n`` (None: all)."""
    w = Window.partitionBy(qid).orderBy(F.round("sim", SCORE_PLACES).desc(), F.col(doc).asc())
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= n) if n is not None else out


def top_similar(docs: DataFrame, queries: DataFrame, qid: str, doc: str, n: int | None) -> DataFrame:
    """``(qid, doc, sim, rank)`` for ``docs(doc, term, u)`` and ``queries(qid, term, v)``.

    The ``n`` most similar of the documents that share a term with the query; None ranks all of them.
    """
    if n is None:
        return ranked(queries.join(docs, "term").groupBy(qid, doc).agg(F.sum(F.col("u") * F.col("v")).alias("sim")), qid, doc, None)
    queries = materialize(queries)
    # the queries' terms go to the postings where they are few
    few = F.broadcast if queries.count() <= MAX_BROADCAST_TERMS else (lambda df: df)
    asked = docs.join(few(queries.select("term").distinct()), "term", "left_semi")
    size = max(n, HEAD_POSTINGS)

    # each term's head; the weight of its last posting bounds those behind it
    by_weight = Window.partitionBy("term").orderBy(F.col("u").desc(), F.col(doc).asc())
    head = materialize(asked.withColumn("place", F.row_number().over(by_weight)).where(F.col("place") <= size))
    behind = head.groupBy("term").agg(F.when(F.max("place") == size, F.min("u")).otherwise(0.0).alias("behind"))
    terms = queries.join(behind, "term").withColumn("most", F.col("v") * F.col("behind"))

    # the bound: n-th partial score of the heads
    seen = head.join(terms.select(qid, "term", "v", "most"), "term").select(qid, doc, "term", (F.col("u") * F.col("v")).alias("part"), "most")
    partial = seen.groupBy(qid, doc).agg(F.sum("part").alias("part"))
    nth = Window.partitionBy(qid).orderBy(F.col("part").desc())
    bound = (partial.withColumn("place", F.row_number().over(nth)).where(F.col("place") <= n).groupBy(qid)
             .agg(F.when(F.max("place") == n, F.min("part")).otherwise(0.0).alias("bound")))

    # terms from the smallest contribution on that stay below the bound together aren't essential
    upward = Window.partitionBy(qid).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.join(bound, qid).withColumn("essential", F.sum("most").over(upward) >= F.col("bound") * (1 - SLACK))
    terms = materialize(terms.select(qid, "term", "v", "most", "essential", "bound"))

    # a document's known part, and what its unknown terms can add at most
    whole = terms.where("essential AND most > 0")
    rest = terms.where("NOT essential").groupBy(qid).agg(F.sum("most").alias("rest"))
    from_whole = asked.join(few(whole.select(qid, "term", "v")), "term").select(qid, doc, (F.col("u") * F.col("v")).alias("part"), F.lit(0.0).alias("covered"))
    from_head = (head.join(terms.where("NOT essential OR most = 0").select(qid, "term", "v", "most"), "term")
                 .select(qid, doc, (F.col("u") * F.col("v")).alias("part"), F.col("most").alias("covered")))
    known = from_whole.unionByName(from_head).groupBy(qid, doc).agg(F.sum("part").alias("part"), F.sum("covered").alias("covered"))
    candidates = (known.join(rest, qid, "left").join(bound, qid)
                  .where(F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("covered") >= F.col("bound") * (1 - SLACK)).select(qid, doc))
    candidates = materialize(candidates)

    # postings meet the candidates by document, and no row per candidate and query term is shuffled
    scores = (candidates.join(asked, doc).join(few(terms.select(qid, "term", "v")), [qid, "term"])
              .groupBy(qid, doc).agg(F.sum(F.col("u") * F.col("v")).alias("sim")))
    return ranked(scores, qid, doc, n)


def bm25_top(model: BM25Model, texts: DataFrame, qid: str, text_col: str, n: int | None, tokenizer=tokenize) -> DataFrame:
    """The ``n`` documents of a global model most similar to every text (None: all that share a term), ranked."""
    docs = unit_vectors(model)
    return top_similar(materialize(docs) if n is not None else docs, unit_queries(model, texts, qid, text_col, tokenizer), qid, model.doc_col, n)


def fit_transform_query(docs: DataFrame, doc_col: str, doc_text: str, queries: DataFrame, qid: str, query_text: str, top_n: int | None = None,
                        tokenizer=tokenize) -> DataFrame:
    """``(qid, doc, sim, rank)``: a model fitted on ``docs`` and asked with ``queries`` in one go."""
    return bm25_top(bm25_fit(docs.select(doc_col, doc_text), [], doc_col, doc_text, tokenizer=tokenizer), queries, qid, query_text, top_n, tokenizer)
