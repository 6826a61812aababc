"""Intermediate tables in the folder all executors share.

A table written here replaces ``localCheckpoint``: it cuts the lineage, it survives the loss of
any executor, and later passes read it in columns.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset in a local session (tests), a new one."""
    path = spark.conf.get(_SETTING, None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set(_SETTING, path)
        _made[path] = spark
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once and return it as a table read back; rows and columns are unchanged."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def temporary(spark: SparkSession, path: str) -> str:
    """``path``, to be removed with the intermediate tables."""
    _made[path] = spark
    return path


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables written inside are removed at the end: a long session need not keep them until it exits.

    The results that read them must have been written or collected by then.
    """
    before = set(_made)
    try:
        yield
    finally:
        _remove([p for p in _made if p not in before and not _is_root(p)])


def compact(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` with a stronger compression, for tables of texts."""
    return materialize(df, name, "zstd")


def gathered(spark: SparkSession, parts: Iterable[Callable[[], DataFrame]], schema: str, name: str) -> DataFrame:
    """The rows of all ``parts``, formed one after the other; what a part has written or shuffled goes before the next begins."""
    path = temporary(spark, f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}")
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        with scope():
            part().write.mode("append").parquet(path)
        gc.collect()
        spark._jvm.System.gc()  # shuffle files stay until the driver's garbage is collected
    return spark.read.schema(schema).parquet(path)


def count_at_most(df: DataFrame, limit: int) -> int:
    """Rows of ``df``, counted no further than ``limit`` + 1."""
    return df.limit(limit + 1).count()


def _is_root(path: str) -> bool:
    return any(other != path and other.startswith(f"{path}/") for other in _made)


def _remove(paths: list[str]) -> None:
    for path in paths:
        spark = _made.pop(path)
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by then; the folder is scratch space anyway
            pass


@atexit.register
def _clean() -> None:
    _remove(list(_made))
