"""Small files, and Parquet files under names of our own, through Hadoop's file systems."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap.session import filesystem


#: Files that the driver makes or renames at a time.
FILES_AT_ONCE = 8


def _create(fs, where, data: bytes | str) -> None:
    out = fs.create(where, True)
    try:
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
    finally:
        out.close()


def put(spark: SparkSession, path: str, data: bytes | str) -> None:
    fs, where = filesystem(spark, path)
    _create(fs, where, data)


def _each(f: Callable, items: Iterable) -> None:
    """Call ``f`` for every item, some at a time."""
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        for _ in pool.map(f, items):
            pass


def put_many(spark: SparkSession, folder: str, files: list[tuple[str, bytes]]) -> None:
    """Small files of one folder, by name."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs, _ = filesystem(spark, folder)
    _each(lambda f: _create(fs, Path(f"{folder}/{f[0]}"), f[1]), files)


def _files_of(spark: SparkSession, folder, number: str) -> dict[int, str]:
    """The one file of each number under a folder that was written by it, as ``NUMBER=i/FILE``; one call of the JVM hands over all names."""
    jvm = spark._jvm
    fs, where = filesystem(spark, folder)
    stat2Paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths
    names = jvm.org.apache.commons.lang3.ArrayUtils.toString(stat2Paths(fs.listStatus(stat2Paths(fs.listStatus(where)))))
    return {int(i): name for name, i in re.findall(rf"/({re.escape(number)}=([0-9]+)/part-[\w.-]+)(?=[,}}])", names)}


def put_numbered(df: DataFrame, number: str, n: int, order: list[str], place: Callable[[int], str], beside: str, each: int = 1) -> None:
    """Write the rows of number i, sorted, as the one file ``place(i)``, for all i below n; the number is not written.

    One job writes all files, ``each`` of them one after another by a task; then
    they are renamed. No rows pass through the driver. All places are under the
    folder ``beside``, next to which they lie in the meantime.
    """
    spark = df.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    under = beside.rstrip("/")
    fs, temporary = filesystem(spark, f"{under}.writing")
    fs.delete(temporary, True)
    again = fs.exists(Path(under))
    placed = df.repartitionById(-(-n // each), F.floor(df[number] / each).cast("int")).sortWithinPartitions(number, *order)
    how = {"compression": "zstd", "maxRecordsPerFile": 0}
    placed.write.options(**how).partitionBy(number).parquet(temporary.toString())
    made = _files_of(spark, temporary.toString(), number)
    # numbers without rows: an empty file with the same columns
    nothing = blank = None
    if len(made) < n:
        nothing = Path(f"{under}.nothing")
        placed.drop(number).limit(0).coalesce(1).write.mode("overwrite").options(**how).parquet(nothing.toString())
        blank = next(s.getPath() for s in fs.listStatus(nothing) if s.getPath().getName().startswith("part-"))
    folders = sorted({place(i).rpartition("/")[0] for i in range(n)})
    _each(lambda folder: fs.mkdirs(Path(folder)), folders)

    def settle(i: int) -> None:
        target = Path(place(i))
        if again:
            fs.delete(target, True)
        if i in made:
            if not fs.rename(Path(f"{temporary.toString()}/{made[i]}"), target):
                raise OSError(f"{made[i]} cannot be renamed to {place(i)}")
        else:
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, blank, fs, target, False, spark._jsc.hadoopConfiguration())

    _each(settle, range(n))
    fs.delete(temporary, True)
    if nothing is not None:
        fs.delete(nothing, True)
