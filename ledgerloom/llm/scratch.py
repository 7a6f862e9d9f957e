"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).

    Where the setting is missing, a session on one machine gets a folder of its
    own; on a cluster such a folder would not be shared, so this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read of Parquet, not a recomputation, and
    a plan that uses the rows several times computes them once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it any more."""
    path = df.__dict__.pop("_written_to", None)
    if path:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def free_name(columns: list[str], stem: str) -> str:
    """``stem``, with underscores before it until no column starts with it (Spark ignores case)."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(stem.lower()) for c in taken):
        stem = f"_{stem}"
    return stem


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` written with a number that differs for every row, null and repeated ids included."""
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name)


def handing_back(run):
    """``run`` (over record batches) that returns freed memory to the system at the end of a task; idle workers would keep it beside the next stage's."""

    @functools.wraps(run)
    def ended(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return ended
