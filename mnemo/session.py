"""SparkSession helpers.

Library code never creates a session on its own; callers (tests, bench,
CLI) use :func:`get_spark`.  Settings follow the scale notes in the README:
AQE on (runtime coalescing and skew-join splitting), UTC session clock,
Arrow for the few pandas-backed operators, UI off.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "mnemo") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MNEMO_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is; a cluster
    session without it is an error, as executors would write to their own disks.
    Only a local master without it gets a scratch folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: name a folder that all executors of {master} share")
        conf = tempfile.mkdtemp(prefix="mnemo-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    spark.sparkContext.setCheckpointDir(conf)
    return conf


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, for clusters where it is not installed
    (``pip install .`` on the nodes, or in the image, makes this needless)."""
    import zipfile
    from pathlib import Path
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="mnemo-pkg-")) / "mnemo.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in here.rglob("*.py"):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(out))


def session_time_zone(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.session.timeZone", "UTC") or "UTC"


def materialize(df):
    """Reliable checkpoint computed once: persist, write the checkpoint from the
    cached blocks, then release the cache (an uncached eager checkpoint would
    compute the plan twice).  The result reads from ``spark.checkpoint.dir``, so a
    lost executor does not replay the lineage."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
