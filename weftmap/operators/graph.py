"""From rows to a typed property graph.

Vertices of a type are the rows of all its mappings, merged by subject; a
single-valued property with two values is refused. They are numbered without
gaps, type by type and by subject. An edge joins the identities of its ends to
the numbers; rows that find no vertex are counted and left out.

Numbering: subjects are sorted by ranges, each range counts its own rows, and
the ranges' counts (one row per partition) are summed up in front. So no task
holds more than its range, and the driver holds a number per type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmap import types
from weftmap.errors import Refusal
from weftmap.session import cut, partitions
from weftmap.sources.shapes import Constraint, Shape

MAX_VERTICES = 1 << 32


@dataclass(frozen=True)
class Property:
    name: str
    type: object
    predicate: str
    single: bool
    least: int = 1
    languages: tuple[str, ...] = ()
    datatype: str | None = None

    @property
    def item(self):
        """The type of one value."""
        return self.type[1] if types.is_sequence(self.type) else self.type

    @staticmethod
    def of(c: Constraint, ty=None) -> Property:
        own = c.type if c.type != types.UNKNOWN else ty
        return Property(c.name, own, c.predicate, c.single and own != types.LANG, c.least, c.languages, c.datatype)


@dataclass
class VertexPart:
    """What one mapping says of a type's vertices: a subject and properties, by physical name."""

    df: DataFrame
    subject: Column
    properties: dict[str, tuple[Property, Column]]
    sources: tuple[str, ...] = ()


@dataclass
class EdgePart:
    """What one mapping says of an edge: the identities of both ends. ``target`` may be a sequence."""

    df: DataFrame
    source_iri: Column
    target_iri: Column
    many: bool = False


@dataclass
class VertexTable:
    shape: Shape
    properties: list[Property]
    rows: DataFrame  # dense_id, subject, one column for each single-valued property
    multi: dict[str, DataFrame]  # (src, value) or (src, value, lang)
    first: int = 0
    count: int = 0
    sources: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return self.shape.label


@dataclass
class EdgeTable:
    source: str
    label: str
    target: str
    predicate: str
    single: bool
    rows: DataFrame  # src, dst as dense ids
    dropped: int = 0
    count: int = 0

    @property
    def name(self) -> str:
        return f"{self.source}_{self.label}_{self.target}"


@dataclass
class Graph:
    vertices: list[VertexTable] = field(default_factory=list)
    edges: list[EdgeTable] = field(default_factory=list)

    def vertex(self, label: str) -> VertexTable:
        return next(v for v in self.vertices if v.label == label)

    def edge(self, name: str) -> EdgeTable:
        return next(e for e in self.edges if e.name == name)


INEXACT = "write/unrepresentable"


def as_declared(column: Column, ty, held: T.DataType | None = None, name: str = "") -> Column:
    """A value in its declared type; numbers widen, identities and texts are text.

    A whole or decimal number becomes a double only where the double is that
    number; any other is refused when it is met.
    """
    cast = column.cast(types.spark_type(ty))
    if ty != types.FLOAT or not isinstance(held, (T.LongType, T.DecimalType)):
        return cast
    exact = column.isNull() | F.coalesce(cast.try_cast(held.simpleString()) == column, F.lit(False))
    if isinstance(held, T.LongType):  # 2^63 is cast to the greatest long
        exact = exact & (column.isNull() | (column != F.lit((1 << 63) - 1)))
    told = F.concat(F.lit(f"{INEXACT}: `{name}` holds "), column.cast("string"), F.lit(", which no double is"))
    return F.when(exact, cast).otherwise(F.raise_error(told).cast("double"))


def refused(e: Exception) -> Refusal | None:
    """The refusal that a running query has raised by :func:`as_declared`, if it is one."""
    told = re.search(rf"{INEXACT}: (`[^\n]*?, which no double is)", str(e))
    return Refusal(INEXACT, told[1]) if told else None


def merged(parts: list[VertexPart]) -> tuple[DataFrame, list[Property]]:
    """All rows of a type by position of its properties, those a mapping lacks as nulls: (subject, p0, p1, ..)."""
    properties: dict[str, Property] = {}
    for part in parts:
        for name, (p, _) in part.properties.items():
            properties.setdefault(name, p)
    held = list(properties.values())
    rows = None
    for part in parts:
        columns = [part.subject.cast("string").alias("subject")]
        for i, p in enumerate(held):
            kind = types.spark_type(p.item)
            if p.name not in part.properties:
                columns.append(F.lit(None).cast("array<" + kind.simpleString() + ">" if not p.single else kind).alias(f"p{i}"))
                continue
            own, column = part.properties[p.name]
            if p.single:
                exactly = part.df.select(column).schema[0].dataType if p.type == types.FLOAT else None
                columns.append(as_declared(column, p.type, exactly, p.name).alias(f"p{i}"))
            elif types.is_sequence(own.type):
                columns.append(column.cast("array<" + kind.simpleString() + ">").alias(f"p{i}"))
            else:
                columns.append(F.when(column.isNotNull(), F.array(column.cast(kind))).alias(f"p{i}"))
        own = part.df.select(columns)
        rows = own if rows is None else rows.union(own)
    return rows, held


def collapse(rows: DataFrame, properties: list[Property]) -> DataFrame:
    """One row per subject: (subject, least and greatest of each single-valued property).

    Both skip nulls, and both combine before the shuffle, so a subject with very
    many rows costs a row per task.
    """
    outs = []
    for i, p in enumerate(properties):
        if p.single:
            outs += [F.min(f"p{i}").alias(f"low{i}"), F.max(f"p{i}").alias(f"p{i}")]
    grouped = rows.groupBy("subject")
    return grouped.agg(*outs) if outs else rows.select("subject").distinct()


def conflict_of(properties: list[Property]) -> Column:
    """Of collapsed rows: does some single-valued property have two values?"""
    found = F.lit(False)
    for i, p in enumerate(properties):
        if p.single:
            found = found | ~F.col(f"low{i}").eqNullSafe(F.col(f"p{i}"))
    return found


def numbered(rows: DataFrame, key: str, told: dict[str, Column] | None = None, first: int = 0, name: str = "dense_id") -> tuple[DataFrame, list]:
    """Rows with consecutive numbers from ``first`` in the order of ``key``, nulls last; and a row per partition with its count ``n`` and what was to be ``told``.

    The rows are written once, sorted by ranges. One aggregation counts each
    range; where the ranges begin is a constant of as many numbers.
    """
    n = partitions(rows.sparkSession)
    placed = rows.repartitionByRange(n, F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = cut(placed.withColumns({"_wm_part": F.spark_partition_id(), "_wm_at": within}), "numbered")
    parts = sorted(held.groupBy("_wm_part").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (told or {}).items()]).collect())
    begins, before = [0] * (1 + max((r["_wm_part"] for r in parts), default=0)), first
    for r in parts:
        begins[r["_wm_part"]] = before
        before += r["n"]
    at = F.get(F.lit(begins).cast("array<bigint>"), F.col("_wm_part")) + F.col("_wm_at")
    return held.select(at.cast("long").alias(name), *[F.col(f"`{c}`") for c in rows.columns]), parts


def number(rows: DataFrame, key: str, first: int = 0, name: str = "dense_id") -> DataFrame:
    return numbered(rows, key, None, first, name)[0]


ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|\\^`]*$"


def build_vertices(shape: Shape, parts: list[VertexPart], first: int) -> VertexTable:
    """Merge, check and number the vertices of one type."""
    rows, properties = merged(parts)
    identities = [F.col(f"p{i}") for i, p in enumerate(properties) if p.single and p.type == types.URI]
    bad = F.col("subject").isNull() | ~F.col("subject").rlike(ABSOLUTE)
    asked = {
        "which": F.min(F.when(bad, F.coalesce("subject", F.lit("null")))),
        "two": F.min(F.when(conflict_of(properties), F.col("subject"))),
        "no_iri": F.min(F.coalesce(*[F.when(~c.rlike(ABSOLUTE), c) for c in identities], F.lit(None).cast("string"))),
    }
    try:
        rows = cut(rows, "rows") if any(not p.single for p in properties) else rows
        everything, told = numbered(collapse(rows, properties), "subject", asked, first)  # written once, then checked and read from there
    except Exception as e:
        if (refusal := refused(e)) is not None:
            raise refusal from e
        raise
    which, two, no_iri = (min((r[k] for r in told if r[k] is not None), default=None) for k in asked)
    count = sum(r["n"] for r in told)
    if which is not None:
        raise Refusal("write/invalid-subject", f"`{which}` is not an absolute IRI, and it is the subject of a {shape.label}")
    if two is not None:
        raise Refusal("write/too-many-values", f"{two} has two values for a property of {shape.label} that takes one")
    if no_iri is not None:
        raise Refusal("write/invalid-iri", f"a property of {shape.label} holds `{no_iri}`, which is not an absolute IRI")
    if first + count >= MAX_VERTICES:
        raise Refusal("run/too-large", "a graph has less than 2^32 vertices")
    table = everything.select("dense_id", "subject", *[F.col(f"p{i}").alias(p.name) for i, p in enumerate(properties) if p.single])
    multi = {}
    for i, p in enumerate(properties):
        if p.single:
            continue
        values = rows.select("subject", F.explode(f"p{i}").alias("value")).filter(F.col("value").isNotNull())
        owned = located(values, "subject", table, "dense_id")
        if p.item == types.LANG:
            pairs = owned.select(F.col("dense_id").alias("src"), F.col("value.value").alias("value"), F.lower(F.col("value.lang")).alias("lang"))
            multi[p.name] = pairs.filter(F.col("value").isNotNull()).distinct()
            check_tags(multi[p.name], p)
        else:
            multi[p.name] = owned.select(F.col("dense_id").alias("src"), "value").distinct()
            if p.item == types.URI and (wrong := multi[p.name].filter(~F.col("value").rlike(ABSOLUTE)).agg(F.min("value").alias("v")).first().v) is not None:
                raise Refusal("write/invalid-iri", f"`{p.name}` of {shape.label} holds `{wrong}`, which is not an absolute IRI")
    return VertexTable(shape, properties, table, multi, first, count, tuple(sorted({s for part in parts for s in part.sources})))


def shifted(v: VertexTable, first: int) -> VertexTable:
    """The same vertices, numbered from ``first`` instead of 0."""
    if first + v.count >= MAX_VERTICES:
        raise Refusal("run/too-large", "a graph has less than 2^32 vertices")
    if not first:
        return v
    rows = v.rows.withColumn("dense_id", F.col("dense_id") + F.lit(first).cast("long"))
    multi = {name: values.withColumn("src", F.col("src") + F.lit(first).cast("long")) for name, values in v.multi.items()}
    return replace(v, rows=rows, multi=multi, first=first)


#: A well-formed language tag: a primary subtag, then others of up to eight letters or digits.
TAG = r"^(?:[a-z]{2,8}|x)(?:-[a-z0-9]{1,8})*$"


def check_tags(values: DataFrame, p: Property) -> None:
    told = values.agg(F.min(F.when(F.col("lang").isNull() | ~F.col("lang").rlike(TAG), F.coalesce("lang", F.lit("null")))).alias("bad"), F.sort_array(F.collect_set("lang")).alias("tags")).first()
    if told.bad is not None:
        raise Refusal("write/invalid-language-tag", f"`{told.bad}` is no language tag, in `{p.name}`")
    wrong = [t for t in told.tags if p.languages and not any(t == own or t.startswith(own + "-") for own in p.languages)]
    if wrong:
        raise Refusal("write/language-not-allowed", f"`{p.name}` is not given in `{wrong[0]}`")


def candidates(parts: list[EdgePart]) -> DataFrame:
    """(s, t): the identities of both ends of every edge that some row asks for."""
    pairs = None
    for part in parts:
        target = F.explode(part.target_iri.cast("array<string>")) if part.many else part.target_iri.cast("string")
        own = part.df.select(part.source_iri.cast("string").alias("s"), target.alias("t"))
        pairs = own if pairs is None else pairs.union(own)
    return pairs.filter(F.col("t").isNotNull())


def located(rows: DataFrame, key: str, vertices: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """Rows with the number of the vertex whose subject is in column ``key``; it takes that column's place, as ``name``.

    They meet by a digest, and then subjects are held against each other: a sort
    by numbers is one by digits, where identities, which begin alike, are compared
    whole. The two comparisons say what ``==`` says, but do not become a key of the join.
    """
    own = vertices.select(F.col("subject").alias("_wm_subject"), F.col("dense_id").alias("_wm_id"))
    a, b = F.col(key), F.col("_wm_subject")
    met = rows.join(own, (F.xxhash64(a) == F.xxhash64(b)) & (a <= b) & (a >= b), how)
    return met.select(*[F.col(c) for c in rows.columns if c != key], F.col("_wm_id").alias(name))


def resolve(parts: list[EdgePart], sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, resolved): pairs of identities, and those of them that find both vertices, as (src, dst)."""
    pairs = candidates(parts)
    return pairs, located(located(pairs, "s", sources, "src"), "t", targets, "dst").select("src", "dst")


def build_edges(label: str, predicate: str, single: bool, parts: list[EdgePart], source: VertexTable, target: VertexTable) -> EdgeTable:
    """Resolve, count what is dropped, make a set, and check that a single-valued edge has one target."""
    pairs = candidates(parts)
    # the end with fewer vertices first: where Spark broadcasts them, the other join deals numbers in place of those identities
    ends = sorted([("s", source, "src"), ("t", target, "dst")], key=lambda end: end[1].count)
    met = pairs
    for key, table, name in ends:
        met = located(met, key, table.rows, name, "left")
    # both numbers are below MAX_VERTICES, so a pair is one number; null where an end finds no vertex
    pair = F.shiftleft("src", 32).bitwiseOR(F.col("dst"))
    distinct = met.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(distinct.select(F.shiftrightunsigned("pair", 32).alias("src"), F.col("pair").bitwiseAND(F.lit(MAX_VERTICES - 1)).alias("dst"), "n"), "edges")
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    sums = [F.sum("n").alias("read"), F.sum(F.when(whole, F.col("n"))).alias("found"), F.count_if(whole).alias("edges")]
    if single:  # pairs are distinct: two of one source are two targets
        by = placed.groupBy("src").agg(*sums).agg(F.sum("read").alias("read"), F.sum("found").alias("found"), F.sum("edges").alias("edges"), F.max("edges").alias("most"))
    else:
        by = placed.agg(*sums, F.lit(1).alias("most"))
    told = by.first()
    if single and (told.most or 0) > 1:
        raise Refusal("write/too-many-values", f"a vertex has two targets for `{label}`, which takes one")
    rows = placed.filter(whole).select("src", "dst")
    return EdgeTable(source.label, label, target.label, predicate, single, rows, (told.read or 0) - (told.found or 0), told.edges or 0)


def offsets(edges: DataFrame, vertices: int) -> DataFrame:
    """Where the edges of each source begin in the sorted edges: vertices + 1 rows (vertex, offset).

    A running sum over vertices by ranges of them: one aggregation counts the
    edges of each range (a row per range comes to the driver), another those of
    each vertex, both combined before they are dealt; a window runs within a range.
    """
    spark = edges.sparkSession
    span = max(1, -(-(vertices + 1) // partitions(spark)))
    place = F.floor(F.col("vertex") / span)
    per_range = {r["range"]: r["n"] for r in edges.groupBy(F.floor(F.col("src") / span).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins, before = [], 0
    for i in range(vertices // span + 1):
        begins.append(before)
        before += per_range.get(i, 0)
    every = spark.range(vertices + 1).select(F.col("id").alias("vertex"), F.lit(0).cast("long").alias("n"))
    every = every.union(edges.select(F.col("src").alias("vertex"), F.lit(1).cast("long"))).groupBy("vertex").agg(F.sum("n").alias("n"))
    every = every.withColumn("range", place.cast("int"))
    within = Window.partitionBy("range").orderBy("vertex").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("n").over(within), F.lit(0))
    return every.select("vertex", (F.get(F.lit(begins).cast("array<bigint>"), F.col("range")) + local).cast("long").alias("offset"))


def duplicate_subject(vertices: list[VertexTable]) -> None:
    """A subject belongs to one vertex of the whole graph."""
    rows = None
    for v in vertices:
        own = v.rows.select("subject")
        rows = own if rows is None else rows.union(own)
    if rows is None:
        return
    twice = rows.groupBy("subject").count().filter("count > 1").orderBy("subject").limit(1).collect()
    if twice:
        raise Refusal("write/duplicate-value", f"{twice[0].subject} is the subject of two vertices")
