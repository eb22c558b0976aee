"""Session helpers: a tuned local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Large expressions are built from many small calls; recording the call site of each costs more than the call.
CALL_SITES_CONF = "spark.python.sql.dataFrameDebugging.enabled"

# Largest method that a JVM compiles to machine code; Spark's default for its generated methods is 65535.
METHOD_CONF, METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"


def local_session(cpus: str | int = "*", app: str = "refloom", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches. On a cluster the caller's own session is used unchanged."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REFLOOM_DRIVER_MEMORY", "8g"))
        .config(CALL_SITES_CONF, "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in `spark.checkpoint.dir`.

    Only where the setting is absent (a laptop or a test run on one machine) is a folder of our own made.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _own_dir()


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="run-"))
    return _OWN[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path for an intermediate table or a streaming checkpoint in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """While it is open, a stage whose generated method is too long for the JVM to compile runs as split functions.

    A projection of very many expressions makes one long method, which would be interpreted byte by byte. The session's own
    setting is put back at the end.
    """
    before = spark.conf.get(METHOD_CONF)
    spark.conf.set(METHOD_CONF, METHOD_LIMIT)
    try:
        yield
    finally:
        spark.conf.set(METHOD_CONF, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
