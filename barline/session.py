"""Session helpers shared by the jobs, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "barline") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you have."""
    partitions = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """SQL settings the wide window plans need, safe on any session.

    HotSpot never compiles a method above 8,000 bytes of bytecode, and one fused
    over many window columns is larger.  Below the limit Spark fuses as before;
    above it the operators run unfused but compiled.  Window tasks cost far more
    time than bytes, so small shuffle partitions are not merged into few tasks.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    return spark


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A temporary folder is made only where the setting is absent and Spark runs
    in local mode, so that no job on a cluster writes to one machine's disk.  A
    ``file:`` folder is taken as it is: it may be a mount that all machines share.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    _local_dir = _local_dir or tempfile.mkdtemp(prefix="barline-")
    return _local_dir


#: Paths written below the innermost owner; None outside of one.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what ``written`` has written inside, whether the work succeeded or not.

    For work that ends with tables of its own; frames that still read the removed tables fail.
    """
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back.

    Cuts the lineage of a table that is read many times; the files outlive any
    executor, and go with the ``owned_tables`` around, if any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
