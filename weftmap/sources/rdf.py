"""RDF as tables: the subjects of a class become rows, the predicates that are read become columns.

N-Triples is read by line with one pattern, so it scales with its lines; its
escapes are undone as those of Turtle are. Turtle
has no lines of its own: a file is parsed whole, one file per task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap.errors import Refusal
from weftmap.sources.location import check_exists
from weftmap.sources.turtle import RDF, parse

TURTLE_AT_MOST = 1 << 30
TRIPLES = "s string, p string, o string, tag string"


def _file(batches):
    for pdf in batches:
        rows = []
        for text in pdf["value"]:
            for s, p, o in parse(text):
                rows.append((s[1] if s[0] == "iri" else "_:" + s[1], p, o[1] if o[0] != "blank" else "_:" + o[1], o[3] if o[0] == "literal" else None))
        yield pd.DataFrame(rows, columns=["s", "p", "o", "tag"]).astype(object)


_LINE = r'^\s*(<[^>]*>|_:\S+)\s*<([^>]*)>\s*(<[^>]*>|_:\S+|"((?:[^"\\]|\\.)*+)"(?:@([A-Za-z0-9-]+)|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'

_PIECE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[\s\S]|[^\\]++"


def _unescaped(c):
    """The text with its escapes undone, each once and from left to right, as :func:`turtle.unescape` does it."""

    def plain(piece):
        second = F.substring(piece, 2, 1)
        point = F.decode(F.unhex(F.lpad(F.substring(piece, 3, 8), 8, "0")), "UTF-32")
        control = F.translate(second, "tbnrf", "\t\b\n\r\f")
        return F.when(~piece.startswith("\\"), piece).when(F.length(piece) > 2, point).otherwise(control)

    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(c)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, tag) of a document: IRIs and lexical forms as text."""
    check_exists(spark, path)
    if not path.lower().rstrip("/").endswith(".nt"):
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
        if largest > TURTLE_AT_MOST:
            raise Refusal("source/too-large", f"`{path}`: a Turtle file is parsed whole, and one is {largest} bytes; N-Triples is read by line")
        return spark.read.text(path, wholetext=True).mapInPandas(_file, TRIPLES)
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    bad = lines.filter(~F.col("value").rlike(_LINE)).limit(1).collect()
    if bad:
        raise Refusal("source/unparseable", f"`{path}`: {bad[0].value[:60]!r} is no triple")

    def group(i: int):
        return F.regexp_extract("value", _LINE, i)

    def term(c):
        return F.when(c.startswith("<"), _unescaped(F.regexp_replace(c, "^<|>$", ""))).otherwise(c)

    o = F.when(group(3).startswith('"'), _unescaped(group(4))).otherwise(term(group(3)))
    return lines.select(term(group(1)).alias("s"), _unescaped(group(2)).alias("p"), o.alias("o"), F.nullif(group(5), F.lit("")).alias("tag"))


def pivot(triples: DataFrame, shape, wanted: set[str] | None = None) -> DataFrame:
    """One row per subject of the shape's class, sorted by subject.

    A property that occurs once at most is its least object; others are sorted
    lists. Only the columns that are ``wanted`` are built.
    """
    subjects = triples.filter((F.col("p") == RDF + "type") & (F.col("o") == shape.iri)).select(F.col("s").alias("subject")).distinct()
    constraints = [c for c in shape.constraints if wanted is None or c.name in wanted]
    read = triples.filter(F.col("p").isin([c.predicate for c in constraints])) if constraints else triples.limit(0)
    outs = []
    for c in constraints:
        value = F.when(F.col("p") == c.predicate, F.col("o"))
        outs.append((F.min(value) if c.single else F.sort_array(F.collect_set(value))).alias(c.name))
    if not outs:
        return subjects.orderBy("subject")
    rows = read.groupBy(F.col("s").alias("subject")).agg(*outs)
    joined = subjects.join(rows, "subject", "left").orderBy("subject")
    return joined.select("subject", *[F.col(f"`{c.name}`") if c.single else F.when(F.size(f"`{c.name}`") > 0, F.col(f"`{c.name}`")).alias(c.name) for c in constraints])
