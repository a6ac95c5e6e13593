"""The folder that a cluster shares, and cutting lineage in it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset one of our own: beside the warehouse, or a temporary one if all is in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            at = tempfile.mkdtemp(prefix="weftmap-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        else:
            at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/weftmap-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a location."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended: its folder goes with it
        pass


_open: ContextVar[list[str] | None] = ContextVar("weftmap_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are cut within are removed at the end, for drivers that live long; what was made of them must have been written by then.

    It holds for this thread, and for what :func:`beside` submits from it.
    """
    made: list[str] = []
    before = _open.set(made)
    try:
        yield
    finally:
        _open.reset(before)
        for path in made:
            _forget(spark, path)


def beside(pool: ThreadPoolExecutor, f: Callable, *args) -> Future:
    """Call ``f`` on a thread of the pool, within the :func:`scratch` of this one."""
    return pool.submit(copy_context().run, f, *args)


def fresh_path(spark: SparkSession, name: str, suffix: str = "") -> str:
    """A place in the shared folder that nothing else uses, until the end of the innermost :func:`scratch`, or else of the process."""
    path = f"{shared_dir(spark).rstrip('/')}/weftmap/{name}-{uuid.uuid4().hex}{suffix}"
    made = _open.get()
    if made is not None:
        made.append(path)
    else:
        atexit.register(_forget, spark, path)
    return path


#: Spark removes the shuffle files of a query at its end where this is set; else they lie until the driver's JVM collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = Lock()
_cleaning: dict[str, list] = {}  # by application: how many writes go on, what the setting was


@contextmanager
def _cleaned(spark: SparkSession):
    """The setting, for as long as some thread writes a table."""
    own = spark.sparkContext.applicationId
    with _lock:
        held = _cleaning.setdefault(own, [0, None])
        if not held[0]:
            held[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.unset(CLEANUP) if held[1] is None else spark.conf.set(CLEANUP, held[1])


def cut(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it survives lost executors and is computed once.

    The shuffle files behind it go with the query. ``by``: a column to lay the table's files out by.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _cleaned(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
