"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back.

    The folder is shared by all executors, so the lineage ends there and a lost
    executor costs no recomputation of what stands before it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts go to the workers in batches of about ``BATCH_BYTES``.

    Spark's batches are of 10,000 rows, up to 64 MB: of whole texts, each task holds
    one outside the executor's heap while it grows by doubling, and one in its worker.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


_RESIDENT: dict = {}


def give_back() -> None:
    """Give freed memory back to the system.

    Arrow's pool and the C library keep what was freed, and a worker's memory counts
    as its executor's, whether used or not.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Drop what the process holds resident and give the memory back to the system."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        give_back()


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; what it held is given back when the task ends, not when the worker does."""
    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def resident(key, make):
    """The object that a worker process keeps between tasks, made when it is first asked for.

    There is one at a time: tables and memos of another operator or run are let go,
    so that a worker that serves several stages doesn't hold them all.
    """
    if key not in _RESIDENT:
        let_go()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def slices(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``most`` characters; a longer text is a run of its own."""
    first = held = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if texts:
        yield first, len(texts)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other columns of the input, whatever they are called, are not read."""
    return docs.select(*names)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 3, is 1 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
