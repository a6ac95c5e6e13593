"""CSV, JSON and Parquet.

A CSV file is read as text, and one aggregation over the whole file decides the
type of every column; then the columns are cast. So types do not depend on a
sample, identifiers with leading zeros stay text, and headers keep their names.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmap.errors import Refusal
from weftmap.session import filesystem
from weftmap.sources.location import check_exists

_SIGN = "^[+-]?"
_INTEGER = _SIGN + "[0-9]+$"
_FLOAT = _SIGN + r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ZERO = _SIGN + "0[0-9]"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?$"


def unique_headers(names: list[str]) -> list[str]:
    """Names that repeat, whatever their case, get ``_1``, ``_2`` behind them, or the next that is free."""
    taken: set[str] = set()
    out = []
    for name in names:
        free, n = name, 0
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out.append(free)
    return out


def _decide(c: Column, name: str) -> list[Column]:
    """Aggregates over one text column: how many values, and whether all of them are of a kind."""

    def every(test: Column) -> Column:
        return F.coalesce(F.min(F.when(c.isNotNull(), F.coalesce(test, F.lit(False)))), F.lit(False))

    return [
        F.count(c).alias(f"{name}n"),
        F.coalesce(F.max(c.rlike(_ZERO)), F.lit(False)).alias(f"{name}z"),
        every(c.rlike(_INTEGER) & F.expr(f"try_cast({name} AS BIGINT)").isNotNull()).alias(f"{name}i"),
        every(c.rlike(_FLOAT)).alias(f"{name}f"),
        every(F.lower(c).isin("true", "false")).alias(f"{name}b"),
        every(c.rlike(_DATE) & F.expr(f"try_cast({name} AS DATE)").isNotNull()).alias(f"{name}d"),
        every(c.rlike(_STAMP) & F.expr(f"try_cast({name} AS TIMESTAMP_NTZ)").isNotNull()).alias(f"{name}t"),
    ]


def _type(row, name: str) -> T.DataType:
    if not row[f"{name}n"]:
        return T.StringType()
    if not row[f"{name}z"]:
        if row[f"{name}i"]:
            return T.LongType()
        if row[f"{name}f"]:
            return T.DoubleType()
    for key, kind in (("b", T.BooleanType()), ("d", T.DateType()), ("t", T.TimestampNTZType())):
        if row[f"{name}{key}"]:
            return kind
    return T.StringType()


def _survey(spark: SparkSession, path: str, delimiter: str) -> tuple[list[tuple[list[str], str]], bool]:
    """One pass over the lines: ((files, their first line) for all files that begin alike, in the order of files; whether a quoted field may go over a line's end).

    Doubled quotes and then whole quoted fields are taken out of each line; where
    a quote is left, a record may go over the line's end. A row per file comes to
    the driver, which lists the files as it is.
    """
    sep = re.escape(delimiter)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    left = F.regexp_replace(F.replace("value", F.lit('""'), F.lit("")), f'(^|{sep})"[^"]*+"(?={sep}|$)', "$1")
    broken = F.when(F.col("value").contains('"'), left.contains('"')).otherwise(False)
    head = F.when((F.col("block") == 0) & (F.col("value") != ""), F.struct("at", "value"))
    told = lines.groupBy("file").agg(F.min(head).alias("head"), F.max(broken).alias("broken"), F.max(~F.is_valid_utf8("value")).alias("other")).collect()
    for r in told:
        if r.other:
            raise Refusal("source/not-utf8", f"`{unquote(r.file)}` is not UTF-8")
    alike: dict[str, list[str]] = {}
    for r in sorted(told, key=lambda r: r.file):
        if r["head"] is not None:
            alike.setdefault(r["head"].value, []).append(unquote(r.file))
    return [(files, head) for head, files in alike.items()], any(r.broken for r in told)


def _line_end(spark: SparkSession, path: str | list[str]) -> str | None:
    """How records end, where the reader would not find it or would change breaks in quotes; else None.

    The reader takes the first break of a file, also one in a quoted header, and
    makes ``\\r\\n`` in quotes ``\\n`` unless told. Where files end records in
    both ways it finds the way of each.
    """
    lines = spark.read.text(path, lineSep="\n")
    head = ""
    for row in lines.limit(1000).collect():
        head += row.value + "\n"
        if head.count('"') % 2 == 0:
            break
    if "\r" in re.sub('"[^"]*"', "", head).rstrip("\r\n"):
        return "\r"
    end = "\r\n" if head.endswith("\r\n") else "\n"
    if re.search("[\r\n]", head.rstrip("\r\n")):
        return end
    starts = lines.filter("_metadata.file_block_start = 0").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = starts.groupBy("file").agg(F.min_by("value", "at").alias("value"))
    return end if first.select(F.col("value").endswith("\r")).distinct().count() == 1 else None


def _texts(spark: SparkSession, path: str | list[str], options: dict, over_lines: bool) -> tuple[list[str], DataFrame] | None:
    """(header, rows as texts) of files with one header."""
    if over_lines:
        end = _line_end(spark, path)
        options = options | {"multiLine": True} | ({"lineSep": end} if end else {})
    first = spark.read.options(header=False, inferSchema=False, **options).csv(path).limit(1).collect()
    if not first:
        return None
    header = unique_headers([h or "" for h in first[0]])
    names = [f"c{i}" for i in range(len(header))]
    # each task holds the header of its file against the first, where Spark can tell the names apart
    told_apart = list(first[0]) == header
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (header if told_apart else names)])
    return header, spark.read.options(header=True, enforceSchema=not told_apart, **options).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, limit: int | None = None) -> DataFrame:
    """A file, a glob or a folder with a header; an empty field is null.

    A large file is read by many tasks where all records are lines; if a quoted
    field goes over a line's end somewhere, each file is read by one task. Files
    under one place may have different headers: their columns are merged by name,
    in order of the files, and a column that a file lacks is null in its rows.
    Types are those that hold for all files. ``limit``: the first rows in the
    order of the files.
    """
    if delimiter is not None and len(delimiter.encode()) != 1:
        raise Refusal("provider/invalid-reader-option", "a delimiter is one byte")
    check_exists(spark, path)
    options = {"sep": delimiter or ",", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    alike, over_lines = _survey(spark, path, options["sep"])
    read = [_texts(spark, path if len(alike) == 1 else files, options, over_lines) for files, _ in alike]
    read = [r for r in read if r is not None]
    if not read:
        raise Refusal("source/unparseable", f"`{path}` is empty")
    header = list(dict.fromkeys(name for names, _ in read for name in names))
    names = [f"c{i}" for i in range(len(header))]
    texts = None
    for own, df in read:
        physical = dict(zip(own, df.columns, strict=True))
        held = [F.when(F.col(quoted(physical[h])) != "", F.col(quoted(physical[h]))) if h in physical else F.lit(None).cast("string") for h in header]
        part = df if limit is None else _placed(df)
        part = part.select([c.alias(n) for c, n in zip(held, names, strict=True)] + [F.col(c) for c in (PLACE if limit is not None else ())])
        texts = part if texts is None else texts.union(part)
    decided = texts.agg(*[a for n in names for a in _decide(F.col(n), n)]).first()  # over all rows, whatever the limit
    if limit is not None:
        texts = texts.orderBy(*PLACE).limit(limit).drop(*PLACE)
    cast = [F.col(n).cast(_type(decided, n)) for n in names]
    return texts.select(cast).toDF(*header)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects by line, or one array of objects; texts stay texts; an empty file or array is an error."""
    check_exists(spark, path)
    start = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).limit(1).collect()
    if not start:
        raise Refusal("source/unparseable", f"`{path}` is empty")
    df = spark.read.options(multiLine=start[0].c == "[", mode="FAILFAST", primitivesAsString=False).json(path)
    if not df.columns:
        raise Refusal("source/unparseable", f"`{path}` holds no object")
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder or glob whose files' schemas are merged."""
    check_exists(spark, path)
    fs, where = filesystem(spark, path)
    single = fs.exists(where) and fs.getFileStatus(where).isFile()
    return spark.read.option("mergeSchema", not single).parquet(path)


#: Where a row stands in the files that it is read from.
PLACE = ("_wm_file", "_wm_block", "_wm_at")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _placed(df: DataFrame) -> DataFrame | None:
    """The rows with their places, or None where they are not those of files."""
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    try:
        return df.select("*", *[c.alias(n) for c, n in zip(place, PLACE, strict=True)])
    except AnalysisException:
        return None


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of the files (by name, then as they stand), the same at each read.

    Spark deals files to tasks by size, so rows are ordered by file, block and
    row; each task keeps n rows. Of rows that do not come from files the first in
    the order of partitions are taken.
    """
    placed = _placed(df)
    if placed is None:
        return df.coalesce(1).limit(n)
    return placed.orderBy(*PLACE).limit(n).select([F.col(quoted(c)) for c in df.columns])
