"""Readers for the parquet tables a deployment points us at."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one table; an explicit column list keeps the scan's ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df.select(*columns) if columns else df)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a scan that yields fewer splits than the default
    parallelism (a small file with one row group is a single task).

    A round-robin repartition of that small input; filters and column pruning
    still reach the scan below it.  A large table already has more splits than
    cores and is returned unchanged, so nothing is shuffled at scale.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
