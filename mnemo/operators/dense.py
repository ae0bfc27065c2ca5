"""Exact nearest-vector candidates (squared L2), many requests in one pass.

Few requests are answered in one scan, each task giving its ``k`` nearest (ties at the k-th distance are kept).  Many are
answered from the store's packs (``recall_store``): the request table (one query vector + its prefilter per request) is broadcast in
blocks of bounded size.  A part of the rows, chosen by their numbers, tells each request a distance that a little more than ``k`` rows of the
store should not exceed; a scan then measures all rows, in single precision where that surely rules a row out and
exactly else, and only rows within the distance leave a task, packed per block of requests.  Where these are
merged they are counted: a request that was told too small a distance asks again with a larger one, so what is kept are always the
``k`` nearest of all rows, in the order of (distance, doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..schema import CANDIDATE_LIMIT, META_DOCUMENT_TYPES
from .recall_store import RecallStore, as_bytes, as_table, empty, numbers, own_settings, scratch_folder, tables, vector_tables

# largest request block broadcast at once (rows of ~dim floats each)
MAX_BROADCAST_REQUESTS = 20000
# numpy working-set bounds inside a task: requests x rows per distance block, pairs x dim measured again
REQ_CHUNK = 128
ROW_CHUNK = 16384
PAIR_CHUNK = 32768
# so many requests need no bounds: what they emit is small
UNBOUNDED_REQUESTS = 256
# rounding error of a distance in product form, relative to the squared lengths of both vectors
SLACK = 1e-11
# requests measured at once against a pack, and the rows that tell the requests' bounds
PACK_REQUESTS = 256
SAMPLE_ROWS = 65536
SAMPLE_REQUESTS = 64
# squared lengths that single precision has room for
SINGLE_ROOM = 1e30
# candidates of a block of requests, which a task merges
CANDIDATES_AT_ONCE = 1_500_000
CANDIDATES_AT_LEAST = 100_000

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("distance", T.DoubleType(), False),
])


def squared_l2(a, b):
    """Squared L2 distance of two ARRAY<FLOAT> columns as a native expression."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
                       F.lit(0.0), lambda acc, v: acc + v)


def mean_vectors(store: DataFrame, docs: DataFrame) -> DataFrame:
    """``(request_id, qvec)``: the mean of the stored vectors of a request's ``docs(request_id, doc_id)``."""
    parts = (docs.join(store.select("doc_id", "index"), "doc_id").select("request_id", F.posexplode("index").alias("i", "x"))
             .groupBy("request_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x")))
    # one entry per dimension
    return parts.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("qvec"))


def _request_block(rows: list) -> dict:
    """Vectors and prefilters of the requests; those with the same prefilter lie side by side, then those of a scoring block."""
    rows = sorted(rows, key=lambda r: (r["document_type"] or "", r["document_type"] is None, r["filter_metadocs"] is False, r.get("block") or 0, int(r["k_eff"])))
    dims = [len(r["qvec"]) for r in rows if r["qvec"] is not None]
    q = None
    if dims:  # a request without a vector searches from the origin
        q = np.array([np.zeros(dims[0]) if r["qvec"] is None else np.asarray(r["qvec"], dtype=np.float64) for r in rows])
    return {
        "ids": [r["request_id"] for r in rows],
        "q": q,
        "doc_type": [r["document_type"] for r in rows],
        "metadocs": np.array([True if r["filter_metadocs"] is None else bool(r["filter_metadocs"]) for r in rows]),
        "excl": [r["exclude_conversation_id"] for r in rows],
        "only": [r["only_conversation_id"] for r in rows],
        "k": np.array([int(r["k_eff"]) for r in rows]),
        "bound": np.array([np.inf if r.get("bound") is None else r["bound"] for r in rows]),
        "block": np.array([r.get("block") or 0 for r in rows], dtype=np.int64),
        "left_out": [r.get("left_out") for r in rows],
        "at": np.array([r.get("at") or 0 for r in rows], dtype=np.int64),
    }


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of an array column as rows; null components are NaN."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("the vectors of a store must be of one length")
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values, dtype=np.float64).reshape(len(sizes), -1)


def _codes(values: np.ndarray, asked: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a batch's values, and of the asked ones among them: -1 for a null value, -2 for one that isn't
    in the batch, -3 where none is asked for."""
    codes, known = pd.factorize(values)
    place = {v: i for i, v in enumerate(known)}
    return codes, np.array([-3 if v is None else place.get(v, -2) for v in asked], dtype=np.int64)


def _distances(blk: dict, rows: pa.Table):
    """For chunks of requests ``(first, take, mat, q, d, slack)``: ``d[i, j]`` is the distance of request ``first + i`` (vector
    ``q[i]``) and row ``take[j]`` (vector ``mat[j]``), off by ``slack[i, j]`` at most and infinite where the request's
    prefilter rules the row out.

    The product form is only used to bound: what is kept is measured again, component by component.
    """
    mat = _matrix(rows["index"].combine_chunks())
    q = np.zeros((len(blk["ids"]), mat.shape[1])) if blk["q"] is None else blk["q"]
    dtype = rows["document_type"].to_numpy()
    type_code, type_asked = _codes(dtype, blk["doc_type"])
    conv_code, excl = _codes(rows["conversation_id"].to_numpy(), blk["excl"])
    only = _codes(rows["conversation_id"].to_numpy(), blk["only"])[1]
    is_meta = np.isin(dtype, np.array(META_DOCUMENT_TYPES, dtype=object))
    # rows that no request can take: no finite vector, or of a type that none of them asks for
    some = np.isfinite(mat).all(axis=1)
    if (type_asked != -3).all():
        some &= np.isin(type_code, type_asked)
    if blk["metadocs"].all():
        some &= ~is_meta
    take = np.flatnonzero(some)
    mat, type_code, conv_code, is_meta = mat[take], type_code[take], conv_code[take], is_meta[take]
    by_conv = np.argsort(conv_code, kind="stable")
    first_of, end_of = (np.searchsorted(conv_code[by_conv], excl, side) for side in ("left", "right"))
    size = (mat * mat).sum(axis=1)
    for r0 in range(0, len(q), REQ_CHUNK):
        r = slice(r0, min(len(q), r0 + REQ_CHUNK))
        total = (q[r] * q[r]).sum(axis=1)[:, None] + size[None, :]
        d = total - 2.0 * (q[r] @ mat.T)
        if (type_asked[r] != -3).any():
            d[(type_asked[r, None] != -3) & (type_asked[r, None] != type_code[None, :])] = np.inf
        if is_meta.any():
            d[blk["metadocs"][r, None] & is_meta[None, :]] = np.inf
        if (only[r] != -3).any():
            d[(only[r, None] != -3) & (only[r, None] != conv_code[None, :])] = np.inf
        for i in np.flatnonzero(excl[r] >= 0):
            d[i, by_conv[first_of[r0 + i]:end_of[r0 + i]]] = np.inf
        yield r0, take, mat, q[r], d, SLACK * total


def _make_nearest(bc):
    """The ``k`` nearest rows of a block per request (ties at the k-th distance are kept)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = bc.value
        ids = pa.array(blk["ids"], pa.string())
        for rows in tables(batches, ROW_CHUNK):
            docs = rows["doc_id"].combine_chunks()
            for r0, take, mat, q, d, slack in _distances(blk, rows):
                kth, most = np.full(len(q), np.inf), int(blk["k"][r0:r0 + len(q)].max())
                if d.shape[1] > most:
                    kth = np.partition(d + slack, most - 1, axis=1)[:, most - 1]
                rr, cc = np.nonzero((d - slack <= kth[:, None]) & (d < np.inf))
                for at in range(0, len(rr), PAIR_CHUNK):
                    r, c = rr[at:at + PAIR_CHUNK], cc[at:at + PAIR_CHUNK]
                    exact = ((q[r] - mat[c]) ** 2).sum(axis=1)  # the exact sum of squared differences
                    near = (exact <= kth[r]) & np.isfinite(exact)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[near] + r0)), docs.take(pa.array(take[c[near]])), pa.array(exact[near])],
                                                     ["request_id", "doc_id", "distance"])

    return run


def _kinds(blk: dict, rows: pa.Table, mat: np.ndarray):
    """For runs ``(first, end, take)`` of requests with the same prefilter by type: the rows that it lets pass."""
    dtype = rows["document_type"].to_numpy()
    finite, is_meta = np.isfinite(mat).all(axis=1), np.isin(dtype, np.array(META_DOCUMENT_TYPES, dtype=object))
    kinds = list(zip(blk["doc_type"], blk["metadocs"].tolist()))
    cuts = [i for i in range(len(kinds)) if i == 0 or kinds[i] != kinds[i - 1]] + [len(kinds)]
    for first, end in zip(cuts, cuts[1:]):
        asked, metadocs = kinds[first]
        some = finite & ~is_meta if metadocs else finite
        take = np.flatnonzero(some if asked is None else some & (dtype == asked))
        if len(take):
            yield first, end, take


def _product_side(mat: np.ndarray, size: np.ndarray, rest: float, kind) -> np.ndarray:
    """The factor of ``_product`` for rows."""
    return np.ascontiguousarray(np.column_stack([mat, rest * size]).T, dtype=kind)


def _product(q: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Squared distances less the requests' squared lengths."""
    return np.column_stack([-2.0 * q, np.ones(len(q))]).astype(side.dtype) @ side


def _rounding(dim: int, kind) -> float:
    """A product's rounding error relative to the squared lengths of both vectors, at most."""
    return 4 * (dim + 8) * float(np.finfo(kind).eps)


def _told_bounds(blk: dict, rows: pa.Table, share: float, widen: float) -> np.ndarray:
    """Per request a distance that about ``k`` rows of the store or some more do not exceed, by the ``share`` of them in ``rows``."""
    out = np.full(len(blk["ids"]), np.inf)
    wanted = blk["k"] * share
    place = blk["k"] if share >= 1 else np.ceil(widen * (wanted + 4 * np.sqrt(wanted) + 4)).astype(np.int64)
    mat = _matrix(rows["index"].combine_chunks())
    q = np.zeros((len(out), mat.shape[1])) if blk["q"] is None else blk["q"]
    conv_code, excl = _codes(rows["conversation_id"].to_numpy(), blk["excl"])
    only = _codes(rows["conversation_id"].to_numpy(), blk["only"])[1]
    q_size, size = (q * q).sum(axis=1), (mat * mat).sum(axis=1)
    for first, end, take in _kinds(blk, rows, mat):
        kind = np.float32 if max(q_size[first:end].max(), size[take].max()) < SINGLE_ROOM else np.float64
        error, side = _rounding(mat.shape[1], kind), _product_side(mat[take], size[take], 1.0, kind)
        by_conv = np.argsort(conv_code[take], kind="stable")
        first_of, end_of = (np.searchsorted(conv_code[take][by_conv], excl, end_side) for end_side in ("left", "right"))
        for r0 in range(first, end, SAMPLE_REQUESTS):
            r = slice(r0, min(end, r0 + SAMPLE_REQUESTS))
            p, d = place[r], _product(q[r], side)
            if d.shape[1] < p.min():
                continue
            if (only[r] != -3).any():
                d[(only[r, None] != -3) & (only[r, None] != conv_code[take][None, :])] = np.inf
            for i in np.flatnonzero(excl[r] >= 0):
                d[i, by_conv[first_of[r0 + i]:end_of[r0 + i]]] = np.inf
            most = min(int(p.max()), d.shape[1])
            near = np.sort(np.partition(d, most - 1, axis=1)[:, :most], axis=1)[np.arange(len(p)), np.minimum(p, most) - 1].astype(float)
            out[r] = np.where(p <= most, near + q_size[r] + 2 * error * (q_size[r] + size[take].max()), np.inf)
    return out


def _within_bounds(blk: dict, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Requests, rows and exact distances of the pairs within the requests' bounds, ``PACK_REQUESTS`` requests at a time.

    A product in single precision rules out what is farther away than its rounding error allows; the others are measured.
    """
    mat = _matrix(rows["index"].combine_chunks())
    q = np.zeros((len(blk["ids"]), mat.shape[1])) if blk["q"] is None else blk["q"]
    conv_code, excl = _codes(rows["conversation_id"].to_numpy(), blk["excl"])
    only = _codes(rows["conversation_id"].to_numpy(), blk["only"])[1]
    q_size, size = (q * q).sum(axis=1), (mat * mat).sum(axis=1)
    for first, end, take in _kinds(blk, rows, mat):
        kind = np.float32 if max(q_size[first:end].max(), size[take].max()) < SINGLE_ROOM else np.float64
        rest = 1.0 - _rounding(mat.shape[1], kind)  # the product is made too small by more than its error
        side = _product_side(mat[take], size[take], rest, kind)
        for r0 in range(first, end, PACK_REQUESTS):
            r = slice(r0, min(end, r0 + PACK_REQUESTS))
            product = _product(q[r], side)
            most = np.nextafter((blk["bound"][r] - rest * q_size[r]).astype(kind) + kind(1e-36), kind(np.inf))
            hits = np.zeros(-(-product.size // 8) * 8, bool)
            np.less_equal(product, most[:, None], out=hits[:product.size].reshape(product.shape))
            near = np.flatnonzero(hits.view(np.uint64))  # eight at a time, as few are set
            near = (near[:, None] * 8 + np.arange(8)).ravel()
            near = near[hits[near]]
            rr, cc = near // len(take) + r0, take[near % len(take)]
            if (only[r] != -3).any():
                mine = (only[rr] == -3) | (only[rr] == conv_code[cc])
                rr, cc = rr[mine], cc[mine]
            others = (excl[rr] < 0) | (excl[rr] != conv_code[cc])
            rr, cc = rr[others], cc[others]
            exact = np.empty(len(rr))
            for at in range(0, len(rr), PAIR_CHUNK):
                a = slice(at, at + PAIR_CHUNK)
                exact[a] = ((q[rr[a]] - mat[cc[a]]) ** 2).sum(axis=1)  # the exact sum of squared differences
            kept = (exact <= blk["bound"][rr]) & np.isfinite(exact)
            yield rr[kept], cc[kept], exact[kept]


PAIRS_SCHEMA = "block int, pos binary, code binary, distance binary, ids binary"


def _make_pairs(bc, starts: np.ndarray, with_ids: bool):
    """Rows within bounds, packed per pack and block of requests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = bc.value
        for rows in vector_tables(batches):
            code = numbers(starts, rows["_n"].to_numpy())
            for r, c, exact in _within_bounds(blk, rows):
                cuts = np.flatnonzero(np.r_[True, np.diff(blk["block"][r]) != 0]) if len(r) else []
                for a, z in zip(cuts, [*cuts[1:], len(r)]):
                    ids = as_bytes(rows.select(["doc_id"]).take(pa.array(c[a:z])).combine_chunks().to_batches()[0]) if with_ids else None
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([blk["block"][r[a]]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (r[a:z].astype(np.int32), code[c[a:z]], exact[a:z])),
                         pa.array([ids], pa.binary())], ["block", "pos", "code", "distance", "ids"])

    return run


FOUND_SCHEMA = "block int, request_id string, short boolean, codes binary, distances binary, ids binary"


def _make_merged(bc, k: int, with_ids: bool):
    """Per request id of a block the ``k`` nearest of its pairs in the order of (distance, code); ``short`` if one of its rows was told too
    small a bound.  ``k`` is widened by a request's extra rows where documents are left out later."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, held = bc.value, {}
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                held.setdefault(block, []).append(tuple(b.column(c)[i].as_buffer().to_pybytes() if b.column(c)[i].is_valid else None for c in ("pos", "code", "distance", "ids")))
        rid, names = pd.factorize(np.array(blk["ids"], dtype=object))
        for block in list(held):
            packed = held.pop(block)
            pos, code, distance = (np.concatenate([np.frombuffer(p[i], t) for p in packed]) for i, t in enumerate((np.int32, np.int64, np.float64)))
            ids = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(p[3])).read_all() for p in packed]).combine_chunks()["doc_id"].combine_chunks() if with_ids else None
            del packed
            found = np.bincount(pos, minlength=len(rid))
            order = np.lexsort((code, distance, rid[pos]))
            pos, code, distance = pos[order], code[order], distance[order]
            cuts = np.flatnonzero(np.r_[True, np.diff(rid[pos]) != 0])
            of_block = {}
            for p in np.flatnonzero(blk["block"] == block):
                of_block.setdefault(rid[p], []).append(p)
            for a, z in zip(cuts, [*cuts[1:], len(pos)]):
                rows = of_block[rid[pos[a]]]
                short = any(found[p] < blk["k"][p] and blk["bound"][p] < np.inf for p in rows)
                mine = np.arange(a, z)
                left_out = [x for p in rows for x in (blk["left_out"][p] or ())]
                if left_out:
                    mine = mine[~np.isin(code[a:z], left_out)]
                mine = mine[:k if left_out else max(blk["k"][p] for p in rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([names[rid[pos[a]]]], pa.string()), pa.array([short]),
                     pa.array([code[mine].tobytes()], pa.binary()), pa.array([distance[mine].tobytes()], pa.binary()),
                     pa.array([as_bytes(pa.RecordBatch.from_arrays([ids.take(pa.array(order[mine]))], ["doc_id"])) if with_ids else None], pa.binary())],
                    ["block", "request_id", "short", "codes", "distances", "ids"])

    return run


def _unfound(asked: DataFrame, path: str) -> list[str]:
    """Requests with a bound of which no attempt has found all, such that found none at all among them."""
    found = asked.sparkSession.read.schema(FOUND_SCHEMA).parquet(path).where("NOT short").select("request_id")
    return [r[0] for r in asked.where(F.col("bound") < np.inf).select("request_id").distinct().join(found, "request_id", "left_anti").collect()]


def find_nearest(store: RecallStore, req: DataFrame, k: int, n_blocks: int, with_ids: bool = False, max_broadcast: int = MAX_BROADCAST_REQUESTS,
                 sample_rows: int = SAMPLE_ROWS) -> str:
    """A folder (``scratch_folder``) of ``FOUND_SCHEMA`` rows by ``block``, one whole row (not ``short``) per request id that finds any.

    ``req``: the columns of ``dense_candidates`` with ``k_eff`` and ``left_out`` (codes of documents that a request must not
    find), written already; null ids ask for nothing.  ``block`` is ``pmod(xxhash64(request_id), n_blocks)``.
    """
    spark = store.spark
    path, tasks = scratch_folder(spark, "found"), 2 * spark.sparkContext.defaultParallelism
    empty(spark, FOUND_SCHEMA).write.partitionBy("block").parquet(path)
    if not store.n_vectors:
        return path
    req = req.where("request_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("request_id"), F.lit(n_blocks)).cast("int"))
    sample, share = store.sample(sample_rows)
    held = spark.sparkContext.broadcast(sample)

    def told(widen):
        def run(batches):
            rows = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(x)).read_all() for x in held.value]).combine_chunks() if held.value else None
            for t in tables(batches, 1024):
                if rows is None or widen is None:
                    bound = np.full(len(t), np.inf)
                else:
                    asked = [{**r, "at": i} for i, r in enumerate(t.to_pylist())]
                    blk = _request_block(asked)
                    bound = np.full(len(t), np.inf)
                    bound[blk["at"]] = _told_bounds(blk, rows, share, widen)
                yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in t.column_names), pa.array(bound)], [*t.column_names, "bound"])
        return run

    kinds = ", ".join(f"{c} {t}" for c, t in req.dtypes)
    for widen in (1, 4, 32, None):
        asked = materialize(req.repartition(tasks).mapInArrow(told(widen), f"{kinds}, bound double"))
        at_once = max(1, max_broadcast * n_blocks // max(asked.count(), 1))
        with own_settings(spark):
            for first in range(0, n_blocks, at_once):
                rows = asked.where(F.col("block").between(first, first + at_once - 1)).toArrow().to_pylist()
                if not rows:
                    continue
                blk = spark.sparkContext.broadcast(_request_block(rows))
                pairs = store.vector_packs().mapInArrow(_make_pairs(blk, store.starts, with_ids), PAIRS_SCHEMA)
                (pairs.repartitionById(min(at_once, n_blocks), F.col("block") - first).mapInArrow(_make_merged(blk, k, with_ids), FOUND_SCHEMA)
                 .write.mode("append").partitionBy("block").parquet(path))
        short = _unfound(asked, path)
        if not short:
            return path
        req = req.join(spark.createDataFrame([(x,) for x in short], "request_id string"), "request_id", "left_semi").select(*req.columns)
    raise AssertionError("requests without a bound find all rows")


def dense_candidates(store: DataFrame, requests: DataFrame, k: int = CANDIDATE_LIMIT,
                     extra: DataFrame | None = None,
                     max_broadcast: int = MAX_BROADCAST_REQUESTS, unbounded: int = UNBOUNDED_REQUESTS) -> DataFrame:
    """``(request_id, doc_id, distance)``: the ``k`` nearest store rows per request, and some more.

    ``store`` needs ``doc_id, index, document_type, conversation_id`` (apply global
    filters before calling; they push down into the scan).  ``requests`` needs
    ``request_id, qvec`` and the prefilter columns ``document_type,
    filter_metadocs, exclude_conversation_id`` (optionally ``only_conversation_id``).  ``extra`` (``request_id, n_extra``)
    widens a request's limit, used to make a later anti-join exact.  So many requests as ``unbounded`` are answered by one
    scan; for more the nearest are found already, and ``rank`` tells their order (not with ``extra``).
    """
    spark = store.sparkSession
    req = nearest_requests(requests, k, extra)
    # size check of the broadcast side
    rows = req.limit(unbounded + 1).collect()
    if not rows:
        return spark.createDataFrame([], CANDIDATE_SCHEMA)
    if len(rows) <= unbounded:
        vec_store = store.select("doc_id", "index", "document_type", "conversation_id").filter(F.col("index").isNotNull())
        blk = _request_block([r.asDict() for r in rows])
        return vec_store.mapInArrow(_make_nearest(spark.sparkContext.broadcast(blk)), CANDIDATE_SCHEMA)
    req = materialize(req)
    packs = RecallStore(store, wanted=reachable(req), with_terms=False)
    n_blocks = blocks_of(spark, req.count() * k)
    path = find_nearest(packs, req, k, n_blocks, with_ids=True, max_broadcast=max_broadcast)
    packs.close()
    ranked = extra is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for request, distances, ids in zip(b.column("request_id"), b.column("distances"), b.column("ids")):
                docs = as_table(ids)["doc_id"].combine_chunks()
                columns = [pa.array([request.as_py()] * len(docs), pa.string()), docs, pa.array(np.frombuffer(distances.as_buffer(), np.float64))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(np.arange(1, len(docs) + 1, dtype=np.int32))] if ranked else [])],
                                                 ["request_id", "doc_id", "distance", *(["rank"] if ranked else [])])

    found = spark.read.schema(FOUND_SCHEMA).parquet(path).where("NOT short").select("request_id", "distances", "ids")
    return found.mapInArrow(run, "request_id string, doc_id string, distance double" + (", rank int" if ranked else ""))


def blocks_of(spark, n_candidates: int) -> int:
    """So many blocks are requests dealt into: each core has some, if there is enough to do, and none holds too many candidates."""
    return max(1, min(2 * spark.sparkContext.defaultParallelism, n_candidates // CANDIDATES_AT_LEAST), -(-n_candidates // CANDIDATES_AT_ONCE))


def nearest_requests(requests: DataFrame, k: int, extra: DataFrame | None = None) -> DataFrame:
    """The columns of ``requests`` that a search reads, and the rows each wants."""
    for c in ("only_conversation_id",):
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast("string"))
    left_out = F.col("left_out") if "left_out" in requests.columns else F.lit(None).cast("array<bigint>").alias("left_out")
    req = requests.select("request_id", "qvec", "document_type", "filter_metadocs", "exclude_conversation_id", "only_conversation_id", left_out)
    req = req.join(extra, "request_id", "left") if extra is not None else req.withColumn("n_extra", F.lit(0))
    n_extra = F.coalesce(F.col("n_extra"), F.lit(0)) + F.coalesce(F.size("left_out"), F.lit(0))
    return req.withColumn("k_eff", (F.lit(k) + F.greatest(n_extra, F.lit(0))).cast("int")).drop("n_extra")


def reachable(req: DataFrame, most: int = 100):
    """A condition on store rows that any row found by one of the requests meets, or None if there are too many kinds of requests."""
    kinds = req.select("document_type", F.coalesce("filter_metadocs", F.lit(True)).alias("meta")).distinct().limit(most + 1).collect()
    if not kinds or len(kinds) > most:
        return None
    no_meta = ~F.coalesce(F.col("document_type").isin(*META_DOCUMENT_TYPES), F.lit(False))
    found = F.lit(False)
    for r in kinds:
        one = F.lit(True) if r["document_type"] is None else F.col("document_type") == r["document_type"]
        found = found | (one & no_meta if r["meta"] else one)
    return found


def top_k_per_request(cands: DataFrame, k_col=None, k: int = CANDIDATE_LIMIT) -> DataFrame:
    """Keep the ``k`` nearest per request, ties broken by doc_id."""
    if "rank" in cands.columns:  # found in this order already
        return cands.filter(F.col("rank") <= (F.lit(k) if k_col is None else k_col))
    w = Window.partitionBy("request_id").orderBy(F.col("distance").asc(), F.col("doc_id").asc())
    limit = F.lit(k) if k_col is None else k_col
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
