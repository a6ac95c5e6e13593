"""The graph as N-Triples: the set of its triples, a line each, sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap import types
from weftmap.operators import graph as G
from weftmap.sources.turtle import RDF


def escaped(text: Column) -> Column:
    """A literal's text with what N-Triples escapes."""
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(plain), F.lit(shown))
    return text


def number(value: Column) -> Column:
    """A double as XML Schema writes it."""
    text = F.replace(value.cast("string"), F.lit("Infinity"), F.lit("INF"))
    return F.when(text.contains("E") | text.contains("N"), text).otherwise(F.concat(text, F.lit("E0")))


def lexical(value: Column, ty, datatype: str) -> Column:
    if ty == types.FLOAT:
        if datatype == types.XSD + "decimal":
            return value.cast("decimal(38,18)").cast("string")
        return number(value)
    if ty == types.YEAR:
        return F.lpad(value.cast("string"), 4, "0")
    if ty == types.DATETIME:
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.regexp_replace(F.date_format(value, "SSSSSS"), "0+$", "")
        return F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return value.cast("string")


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def term(p: G.Property, value: Column, lang: Column | None = None) -> Column:
    if p.item == types.URI:
        return iri(value.cast("string"))
    if p.item == types.LANG:
        return F.concat(F.lit('"'), escaped(value), F.lit('"@'), lang)
    datatype = p.datatype or types.XSD + types.PRIMITIVES[p.item][2]
    quoted = F.concat(F.lit('"'), escaped(lexical(value, p.item, datatype)), F.lit('"'))
    return quoted if datatype == types.XSD + "string" else F.concat(quoted, F.lit(f"^^<{datatype}>"))


def _line(s: Column, predicate: str, o: Column) -> Column:
    return F.concat(iri(s), F.lit(f" <{predicate}> "), o, F.lit(" ."))


def triples(graph: G.Graph) -> DataFrame:
    """One column ``value``, a line per triple. A type's single-valued properties are one pass over its rows."""
    out = None
    ids = None
    for v in graph.vertices:
        lines = [_line(F.col("subject"), RDF + "type", iri(F.lit(v.shape.iri)))]
        lines += [_line(F.col("subject"), p.predicate, term(p, F.col(f"`{p.name}`"))) for p in v.properties if p.single]
        own = v.rows.select(F.explode(F.array(*lines)).alias("value"))
        names = v.rows.select("dense_id", "subject")
        ids = names if ids is None else ids.union(names)
        for p in v.properties:
            if not p.single:
                values = v.multi[p.name].join(names, F.col("src") == F.col("dense_id"))
                lang = F.col("lang") if p.item == types.LANG else None
                own = own.union(values.select(_line(F.col("subject"), p.predicate, term(p, F.col("value"), lang)).alias("value")))
        out = own if out is None else out.union(own)
    for e in graph.edges:
        a = graph.vertex(e.source).rows.select(F.col("dense_id").alias("src"), F.col("subject").alias("s"))
        b = graph.vertex(e.target).rows.select(F.col("dense_id").alias("dst"), F.col("subject").alias("o"))
        out = out.union(e.rows.join(a, "src").join(b, "dst").select(_line(F.col("s"), e.predicate, iri(F.col("o"))).alias("value")))
    return out.filter(F.col("value").isNotNull()).distinct().orderBy("value")


def write(spark: SparkSession, graph: G.Graph, into: str) -> None:
    """Sorted lines under ``into/graph.nt``, a file per range of lines."""
    triples(graph).write.mode("overwrite").text(f"{into.rstrip('/')}/graph.nt")
