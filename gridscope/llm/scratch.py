"""Tables written to the shared folder, to cut lineage and to survive lost executors.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
(tests, a laptop) a temporary local folder is used.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="gridscope-")
        atexit.register(_remove_local, _OWN[key])
    return _OWN[key]


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in whatever case."""
    name, taken = f"__{name}", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def tidy() -> None:
    """Give freed memory back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(batches: Iterator) -> Iterator:
    """The batches of a Python worker, which is tidied up at the end: it lives on for other stages."""
    yield from batches
    tidy()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridscope/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder, once, and read it back."""
    return save_at(df, new_path(df.sparkSession, name))


def save_at(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
