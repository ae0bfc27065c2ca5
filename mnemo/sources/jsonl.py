"""JSON-lines import / export of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TURN_NO_VECTOR
from ..operators.mutations import insert_turns

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = TURN_NO_VECTOR) -> DataFrame:
    """One object per line with an explicit schema (no inference pass); lines that do
    not parse, in whole or in part, are kept in ``_corrupt_record`` instead of failing
    the job.  Blank lines are skipped."""
    sch = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", sch, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")


def bad_lines(raw: DataFrame) -> DataFrame:
    """Lines of a ``read_jsonl`` result that did not parse, in whole or in part."""
    return raw.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write every column, nulls included (``ignoreNullFields=false``)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def export_all(store: DataFrame, path: str) -> None:
    """Dump the store minus the vector."""
    write_jsonl(store.drop("index"), path)


def import_dump(spark: SparkSession, path: str, as_of: int, user_id: str | None = None,
                persona_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows ready to append (defaults filled) and messages per conversation.

    ``user_id`` / ``persona_id`` override the file's keys when given (single
    conversation import); bad lines are not inserted, ``bad_lines`` lists them.
    """
    raw = read_jsonl(spark, path)
    good = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if user_id is not None:
        good = good.withColumn("user_id", F.lit(user_id))
    if persona_id is not None:
        good = good.withColumn("persona_id", F.lit(persona_id))
    rows = insert_turns(good, as_of)
    counts = good.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))
    return rows, counts


def export_conversations(store: DataFrame, keys: DataFrame, path: str, time_zone: str = "UTC") -> None:
    """History of the selected conversations (3-part key) as JSON lines:
    newest branch per sequence number, the standard projection and ``pos``, the row's place in its history."""
    from ..operators.history import conversation_history
    k = ["user_id", "persona_id", "conversation_id"]
    write_jsonl(conversation_history(store, keys, keys=k, time_zone=time_zone), path)
