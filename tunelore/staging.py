"""Intermediate tables in the folder that all executors share.

A multi-pass operator writes what it reads again as Parquet under the
session's ``spark.checkpoint.dir``: the lineage ends there, a lost executor
costs only the tasks it ran, and later passes read columns instead of
repeating shuffles. Where the setting is absent, a temporary folder serves a
local session; a cluster's has none that all executors share, and fails.
Tables are removed when the Python driver ends, or earlier by ``drop``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []
_ONCE: dict[tuple, DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "at" not in _LOCAL:
        _LOCAL["at"] = "file://" + tempfile.mkdtemp(prefix="tunelore-")
    return _LOCAL["at"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, with its rows as written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tunelore-{name}-{uuid.uuid4().hex}"
    df.write.parquet(temporary(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tunelore_path = path
    return out


def temporary(path: str) -> str:
    """``path``, a folder that is removed with the staged tables."""
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.append(path)
    return path


def stage_once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table staged before under ``name`` from the file or folder ``source`` as it is now, or ``make()``, staged."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    mark = (spark.sparkContext.applicationId, source, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime(), name)
    if mark not in _ONCE:
        _ONCE[mark] = stage(make(), name)
    return _ONCE[mark]


def drop(df: DataFrame) -> None:
    """Remove a staged table whose readers have ended."""
    path = getattr(df, "_tunelore_path", None)
    if path in _WRITTEN:
        _remove(df.sparkSession, path)
        _WRITTEN.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_WRITTEN):
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
