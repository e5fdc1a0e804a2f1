"""Helpers shared by the training-data operators: the shared folder and text columns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only where the session leaves it unset (a single-machine run) is one made here.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="keystrata-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when Python ends; what stays is under the shared folder
        pass


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back.

    It cuts the lineage, so that a lost executor costs one stage and not the plan behind it, and gives the
    planner true sizes. The folder goes when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keystrata/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bytes_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a text column (nulls are empty), not copied, and their bounds."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), bounds


def release() -> None:
    """Give memory that a Python worker has freed back to the machine: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that clash with none of ``df``, whatever extra columns it carries."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = f"_{stem}", 0
        while name.lower() in taken:
            n += 1
            name = f"_{stem}{n}"
        taken.add(name.lower())
        out.append(name)
    return out
