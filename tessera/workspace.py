"""Intermediate tables in the folder that driver and executors share.

Long lineages are cut by writing a table here and reading it back. The folder is
``spark.checkpoint.dir`` when the session names one; only a session without it
(tests, a laptop) gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def ship(package: str = "tessera") -> None:
    """Send functions of this package to the executors by value, so they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[package])


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process, in driver and workers alike."""
    name = "_tessera_process_cache"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.store = {}
        sys.modules[name] = module
    return sys.modules[name].store


def release_memory() -> None:
    """Give freed memory back to the system, so that an idle worker does not hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{root(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._settled_at = where
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no plan reads any more."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._settled_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
