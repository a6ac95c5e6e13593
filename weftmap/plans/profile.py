"""Profiles of sources: what their columns are, how many values they have, what identifies a row, what refers to what.

A table is read once for its distinct values: a row per cell, narrow, which
combines by column and value before it is dealt, so a wide table costs its cells
and no more. What is left, (column, value, n), is written by column; counts,
commonest values and inclusions are read from there. Commonest values are asked
only of columns in which values repeat; inclusions only of columns of one type,
onto columns that identify rows, all of them by one join on the values.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmap import types
from weftmap.session import beside, cut
from weftmap.sources.tables import first_rows, quoted

TOP_VALUES = 10
LONGEST_VALUE = 64
SHOWN = 5
COLUMNS_AT_ONCE = 4
#: Types whose values can identify a row.
KEYABLE = {types.STRING, types.INTEGER, types.YEAR, types.DATE, types.DATETIME, types.HOUR, types.URI}


@dataclass
class ColumnProfile:
    name: str
    type: object
    distinct: int = 0
    present: int = 0
    low: str | None = None
    high: str | None = None
    top: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class SourceProfile:
    name: str
    rows: int
    columns: list[ColumnProfile]
    sample: list[list[str | None]] = field(default_factory=list)

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    @property
    def keys(self) -> list[str]:
        """Columns whose values identify a row: of a type that can, never null, all different."""
        return [c.name for c in self.columns if self.rows and c.type in KEYABLE and c.present == self.rows == c.distinct]


@dataclass(frozen=True)
class Inclusion:
    source: str
    column: str
    referenced: str
    key: str


@dataclass
class Profile:
    sources: list[SourceProfile]
    inclusions: list[Inclusion]

    def source(self, name: str) -> SourceProfile:
        return next(s for s in self.sources if s.name == name)


def text(c: Column, ty) -> Column:
    return c.cast("string") if ty != types.LANG else c["value"]


def describe(df: DataFrame) -> list[tuple[str, object]]:
    return [(f.name, types.of_spark(f.dataType)) for f in df.schema]


def _comparable(c: Column, f) -> Column:
    return F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c


def _written(c: Column, f) -> Column:
    """A cell as text that differs where the value does."""
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0).cast(f.dataType)).otherwise(c).cast("string")
    return _comparable(c, f).cast("string")


def values(df: DataFrame) -> DataFrame:
    """(column, value, n): how often each value stands in each column, by the column's place; null is a value."""
    cells = [F.struct(F.lit(i).alias("column"), _written(F.col(quoted(f.name)), f).alias("value")) for i, f in enumerate(df.schema)]
    return df.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell.column", "cell.value").agg(F.count(F.lit(1)).alias("n"))


def _by_column(held: DataFrame) -> DataFrame:
    """(column, distinct, present) of :func:`values`."""
    known = F.col("value").isNotNull()
    return held.groupBy("column").agg(F.count_if(known).alias("distinct"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("present"))


def counts(df: DataFrame) -> DataFrame:
    """One row: ``rows``, and for column i ``distinct_i``, ``present_i``, ``low_i`` and ``high_i`` (the last two as text)."""
    bounds, outs = _bounds(df), ["rows"]
    told = _by_column(values(df))
    each = [F.coalesce(F.max(F.when(F.col("column") == i, F.col(k))), F.lit(0)).alias(f"{k}_{i}") for i in range(len(df.columns)) for k in ("distinct", "present")]
    for i in range(len(df.columns)):
        outs += [f"distinct_{i}", f"present_{i}", f"low_{i}", f"high_{i}"]
    return bounds.withColumn("_wm_one", F.lit(1)).join(told.agg(*each).withColumn("_wm_one", F.lit(1)), "_wm_one").select(outs)


def _bounds(df: DataFrame) -> DataFrame:
    """One row: ``rows``, ``low_i`` and ``high_i``."""
    outs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        comparable = _comparable(F.col(quoted(f.name)), f)
        outs += [F.min(comparable).cast("string").alias(f"low_{i}"), F.max(comparable).cast("string").alias(f"high_{i}")]
    return df.agg(*outs)


def top_values(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """The commonest values that occur twice at least: (value, n), the most frequent first, ties by value."""
    c = F.col(quoted(column))
    grouped = df.filter(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.filter("n >= 2").orderBy(F.col("n").desc(), "value").limit(n)


def inclusion(dependent: DataFrame, column: str, referenced: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct values the column has, and how many of them the key lacks."""
    values = dependent.select(F.col(quoted(column)).alias("value")).filter("value IS NOT NULL").distinct()
    held = referenced.select(F.col(quoted(key)).alias("held")).distinct()
    joined = values.join(held, values["value"] == held["held"], "left")
    return joined.agg(F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("held").isNull()).alias("missing"))


def sample(df: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first rows, every cell as text."""
    return first_rows(df.select([_comparable(F.col(quoted(f.name)), f).cast("string").alias(f.name) for f in df.schema]), n)


def _short(c: Column) -> Column:
    """A text that is long is left out, never cut."""
    return F.when(F.octet_length(c) <= LONGEST_VALUE, c)


def _shown(value: str | None) -> str | None:
    """A value that is long is left out, never cut."""
    return value if value is None or len(value.encode()) <= LONGEST_VALUE else None


def _held(df: DataFrame) -> DataFrame:
    """:func:`values`, written by column."""
    return cut(values(df), "values", by="column")


def _inclusions(found: list[SourceProfile], held: dict[str, DataFrame], keys: dict[tuple[str, str], DataFrame]) -> list[Inclusion]:
    """Which columns hold only values of which keys: of all pairs of one type at once, by a join on type and value."""
    pairs = {}
    for a in found:
        for c in a.columns:
            for b in found:
                for key in b.keys:
                    if c.type in KEYABLE and c.present and (a.name, c.name) != (b.name, key) and b.column(key).type == c.type and c.distinct <= b.rows:
                        pairs[len(pairs)] = (a, c, b, key)
    if not pairs:
        return []
    dependents = {(a.name, c.name): (a, c) for a, c, _, _ in pairs.values()}
    referenced = {(b.name, key): b for _, _, b, key in pairs.values()}

    def cells(df: DataFrame, n: int, ty) -> DataFrame:
        return df.filter("value IS NOT NULL").select(F.lit(n).alias("who"), F.lit(str(ty)).alias("type"), "value")

    sides = []
    for side in (
        [cells(held[a.name].filter(F.col("column") == a.columns.index(c)), n, c.type) for n, (a, c) in enumerate(dependents.values())],
        [cells(keys[k], n, b.column(k[1]).type) for n, (k, b) in enumerate(referenced.items())],
    ):
        whole = side[0]
        for part in side[1:]:
            whole = whole.union(part)
        sides.append(whole)
    mine, theirs = sides[0].withColumnRenamed("who", "a"), sides[1].withColumnRenamed("who", "b")
    met = {(r.a, r.b): r.n for r in mine.join(theirs, ["type", "value"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per pair of columns
    a_at, b_at = {k: n for n, k in enumerate(dependents)}, {k: n for n, k in enumerate(referenced)}
    return [Inclusion(a.name, c.name, b.name, key) for a, c, b, key in pairs.values() if met.get((a_at[a.name, c.name], b_at[b.name, key]), 0) == c.distinct]


def profile(sources: dict[str, DataFrame], depth: int = 0, shown: int = SHOWN) -> Profile:
    """Profile some tables; ``depth``: rows read of each, 0 for all. Referenced keys are always read whole."""
    found, held, keys = [], {}, {}
    for name, whole in sources.items():
        df = first_rows(whole, depth) if depth else whole
        first = sample(df, shown).select([_short(F.col(quoted(c))).alias(c) for c in df.columns]) if shown else None
        bounds, held[name] = _bounds(df).first(), _held(df)
        told = {r["column"]: r for r in _by_column(held[name]).collect()}
        columns = []
        for i, (c, ty) in enumerate(describe(df)):
            distinct, present = (told[i].distinct, told[i].present) if i in told else (0, 0)
            columns.append(ColumnProfile(c, ty, distinct, present, _shown(bounds[f"low_{i}"]), _shown(bounds[f"high_{i}"])))

        def common(i: int, some: DataFrame = held[name]) -> list[tuple[str, int]]:
            repeated = some.filter((F.col("column") == i) & F.col("value").isNotNull() & (F.col("n") >= 2))
            return [(r.value, r.n) for r in repeated.orderBy(F.col("n").desc(), "value").limit(TOP_VALUES).collect() if _shown(r.value) is not None]

        # columns do not depend on each other: a few are asked at a time
        with ThreadPoolExecutor(COLUMNS_AT_ONCE) as pool:
            asked = [(c, beside(pool, common, i)) for i, c in enumerate(columns) if c.distinct < c.present]
            for c, told_top in asked:
                c.top = told_top.result()
        found.append(SourceProfile(name, bounds["rows"], columns, [list(r) for r in first.collect()] if first is not None else []))
        for key in found[-1].keys:
            at = [c.name for c in columns].index(key)
            keys[name, key] = values(whole.select(F.col(quoted(key)))) if depth else held[name].filter(F.col("column") == at)
    return Profile(found, _inclusions(found, held, keys))
