"""A store in packs, as vector searches and memory queries read it.

The rows are dealt into ranges of ``doc_id`` and numbered in its order, so a document's number stands for
its id wherever rows are shuffled, held or compared (equal distances are ordered by it).  A pack is one row with some thousand
documents: their vectors and what requests filter by in one Arrow batch, their term counts and what scores are made of in
another.  Tasks read packs whole, so no row per document passes between the JVM and Python again.

Packs are written once below ``spark.checkpoint.dir`` and deleted when they are no longer used.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .sparse import hashed_tokens, list_values

#: Documents in a pack.
PACK_ROWS = 4096
#: Bytes of packs that a task is handed at once.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
UNION_SETTING = "spark.sql.unionOutputPartitioning"
#: A row's number before it is known how many rows the ranges hold: its range above so many bits, its place below.
PLACE_BITS = 33
PACK_SCHEMA = "part int, last long, n int, vectors binary, terms binary, dictionary binary"
VECTOR_COLUMNS = ["doc_id", "document_type", "conversation_id", "index"]
SCORE_COLUMNS = ["doc_id", "weight", "timestamp", "clen"]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _on_store(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(files, path) -> None:
    try:
        files.delete(path, True)
    except Exception:  # the session has ended, or is just ending: what is left goes with its checkpoints
        pass


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_folder`` named."""
    _delete(*_on_store(spark, path))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, made without workers."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in schema.split(", "))])


@contextmanager
def own_settings(spark: SparkSession):
    """Jobs in this context hand rows to workers in batches of about ``BATCH_BYTES``, unless the session names a size, and
    keep the tasks of a union's parts apart (parts of one partition each may else become a single task)."""
    settings = {UNION_SETTING: "false"} | ({BATCH_SETTING: str(BATCH_BYTES)} if spark.conf.get(BATCH_SETTING, None) is None else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def as_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def as_table(value: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def tables(batches: Iterator[pa.RecordBatch], n_rows: int) -> Iterator[pa.Table]:
    """A task's rows in tables of about ``n_rows`` rows."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, n_rows):
            held.append(b.slice(at, n_rows))
            n += held[-1].num_rows
            if n >= n_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def counted(start: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, terms and counts of documents whose token hashes are ``tokens[start[i]:start[i + 1]]``, and the sorted hashes that
    the terms are places of."""
    n = len(start) - 1
    at, hashes = pd.factorize(tokens, sort=True)
    v = max(len(hashes), 1)
    pairs, tf = np.unique(np.repeat(np.arange(n), np.diff(start)) * v + at, return_counts=True)
    tf = tf.astype(np.uint8 if not len(tf) or tf.max() <= 255 else np.int32)
    return np.bincount(pairs // v, minlength=n), (pairs % v).astype(np.int32), tf, hashes


def _term_pack(rows: pa.Table) -> tuple[bytes, bytes]:
    sizes, terms, tf, hashes = counted(*list_values(rows["tokens"]))
    start = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    columns = {c: rows[c].combine_chunks() for c in ["_n", *SCORE_COLUMNS]}
    columns |= {"terms": pa.ListArray.from_arrays(start, pa.array(terms)), "tf": pa.ListArray.from_arrays(start, pa.array(tf))}
    return as_bytes(pa.RecordBatch.from_pydict(columns)), np.asarray(hashes, dtype=np.int64).tobytes()


def _pack(with_terms: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables(batches, PACK_ROWS):
            parts = rows["_n"].to_numpy() >> PLACE_BITS
            for part in np.unique(parts):
                mine = rows if (parts == part).all() else rows.filter(pa.array(parts == part))
                vec = mine.filter(pa.compute.is_valid(mine["index"])).select(["_n", *VECTOR_COLUMNS])
                # a document without an id is near to requests, but no score is made of it
                terms = _term_pack(mine) if with_terms and part >= 0 else (None, None)
                last = int((mine["_n"].to_numpy() & ((1 << PLACE_BITS) - 1)).max()) if part >= 0 else -1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part)], pa.int32()), pa.array([last], pa.int64()), pa.array([len(vec)], pa.int32()),
                     pa.array([as_bytes(vec.combine_chunks().to_batches()[0]) if len(vec) else None], pa.binary()),
                     pa.array([terms[0]], pa.binary()), pa.array([terms[1]], pa.binary())],
                    ["part", "last", "n", "vectors", "terms", "dictionary"])

    return run


class RecallStore:
    """``rows`` (the turn table with its ``index`` vectors, after ``filter_text``) and its packs.

    ``wanted``: a condition that rows must meet to be found by any request; documents without such a row are left out of the
    packs.  ``with_terms``: False for vector searches alone, which need no more than ``VECTOR_COLUMNS``.
    """

    def __init__(self, store: DataFrame, filter_text=None, wanted: Column | None = None, with_terms: bool = True):
        self.rows = store if filter_text is None else store.filter(filter_text)
        self.spark, self.with_terms = store.sparkSession, with_terms
        self.path = scratch_folder(self.spark, "packs")
        self._drop = weakref.finalize(self, _delete, *_on_store(self.spark, self.path))
        self._drop.atexit = False
        self._write(wanted)

    def _write(self, wanted: Column | None) -> None:
        spark = self.spark
        columns = [*VECTOR_COLUMNS, *(["content", "weight", "timestamp"] if self.with_terms else [])]
        parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = self.rows.select(*columns, (F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("_wanted"))
        dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").withColumn("_n", F.monotonically_increasing_id())
        same = Window.partitionBy("doc_id")  # the ranges are of doc_id, so nothing is shuffled again
        numbered = (dealt.withColumn("_n", F.when(F.col("doc_id").isNotNull(), F.min("_n").over(same)).otherwise(F.lit(-1).cast("long")))
                    .withColumn("_wanted", F.max("_wanted").over(same)).where("_wanted"))
        if self.with_terms:
            numbered = numbered.select("_n", *VECTOR_COLUMNS, "weight", "timestamp", F.char_length("content").alias("clen"), hashed_tokens(F.col("content")).alias("tokens"))
        else:
            numbered = numbered.select("_n", *VECTOR_COLUMNS)
        with own_settings(spark):
            numbered.mapInArrow(_pack(self.with_terms), PACK_SCHEMA).write.parquet(self.path)
        sizes = self.packs().groupBy("part").agg(F.max("last").alias("last"), F.sum("n").alias("n")).collect()
        self.n_vectors = sum(r["n"] for r in sizes)
        held = np.zeros(max([r["part"] for r in sizes], default=-1) + 1, np.int64)
        for r in sizes:
            if r["part"] >= 0:
                held[r["part"]] = r["last"] + 1
        self.starts = np.r_[0, np.cumsum(held)]

    def packs(self) -> DataFrame:
        return self.spark.read.schema(PACK_SCHEMA).parquet(self.path)

    def vector_packs(self) -> DataFrame:
        return self.packs().where("n > 0").select("vectors")

    def codes(self) -> DataFrame:
        """``(doc_id, code)`` of every row with a vector and an id."""
        starts = self.starts

        def run(batches):
            for rows in vector_tables(batches):
                code = numbers(starts, rows["_n"].to_numpy())
                yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), pa.array(code)], ["doc_id", "code"])

        return self.vector_packs().mapInArrow(run, "doc_id string, code long").where("doc_id IS NOT NULL")

    def sample(self, n_rows: int) -> tuple[list[bytes], float]:
        """About ``n_rows`` of the rows with vectors, chosen by their numbers, and their share of all."""
        starts, share = self.starts, min(1.0, n_rows / max(self.n_vectors, 1))

        def run(batches):
            for rows in vector_tables(batches):
                mixed = numbers(starts, rows["_n"].to_numpy()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                some = rows.filter(pa.array((mixed >> np.uint64(11)).astype(float) < share * 2.0 ** 53))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([as_bytes(some.combine_chunks().to_batches()[0])], pa.binary())], ["rows"])

        with own_settings(self.spark):
            return [bytes(r["rows"]) for r in self.vector_packs().mapInArrow(run, "rows binary").collect()], share

    def close(self) -> None:
        """Delete the packs, as also happens when nothing refers to them any more."""
        self._drop()


def numbers(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers of documents in the order of their ids; -1 without one."""
    part = n >> PLACE_BITS
    return np.where(part < 0, -1, starts[np.maximum(part, 0)] + (n & ((1 << PLACE_BITS) - 1)))


def vector_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in batches:
        for value in b.column(0):
            yield as_table(value).combine_chunks()
