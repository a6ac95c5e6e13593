"""The types of values: ten primitives, sequences, references, null.

A type is a string, or a tuple for the two that have parts: ``("Seq", type)``
and ``("Ref", frozenset of class IRIs)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LANG, INTEGER, FLOAT, BOOL = "String", "String<Lang>", "Integer", "Float", "Bool"
YEAR, DATE, DATETIME, HOUR, URI = "Time<Year>", "Time<Date>", "Time<DateTime>", "Time<Hour>", "Uri"
NULL, UNKNOWN = "Null", "Unknown"

LANG_STRUCT = T.StructType([T.StructField("value", T.StringType()), T.StructField("lang", T.StringType())])

# The primitives with how Spark holds them, how the graph files call them, and their XML Schema names.
PRIMITIVES = {
    STRING: (T.StringType(), "string", "string"),
    LANG: (LANG_STRUCT, "langString", None),
    INTEGER: (T.LongType(), "int64", "integer"),
    FLOAT: (T.DoubleType(), "double", "double"),
    BOOL: (T.BooleanType(), "bool", "boolean"),
    YEAR: (T.IntegerType(), "int32", "gYear"),
    DATE: (T.DateType(), "date", "date"),
    DATETIME: (T.TimestampNTZType(), "timestamp", "dateTime"),
    HOUR: (T.StringType(), "string", "time"),
    URI: (T.StringType(), "string", None),
}

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_LANG = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"

# The primitive that each XML Schema datatype is read as.
FROM_XSD = {
    "string": STRING, "normalizedString": STRING, "token": STRING, "language": STRING, "anyURI": STRING,
    "integer": INTEGER, "int": INTEGER, "long": INTEGER, "short": INTEGER, "byte": INTEGER,
    "nonNegativeInteger": INTEGER, "positiveInteger": INTEGER, "nonPositiveInteger": INTEGER, "negativeInteger": INTEGER,
    "unsignedInt": INTEGER, "unsignedLong": INTEGER, "unsignedShort": INTEGER, "unsignedByte": INTEGER,
    "decimal": FLOAT, "float": FLOAT, "double": FLOAT,
    "boolean": BOOL, "gYear": YEAR, "date": DATE, "dateTime": DATETIME, "dateTimeStamp": DATETIME, "time": HOUR,
}


def of_datatype(iri: str) -> str | None:
    """The primitive of an RDF datatype; None if it is none of ours."""
    if iri == RDF_LANG:
        return LANG
    return FROM_XSD.get(iri[len(XSD) :]) if iri.startswith(XSD) else None


def of_spark(kind: T.DataType):
    """The type of a source's column. What the primitives do not cover is read as text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, T.DecimalType):
        return INTEGER if kind.scale == 0 else FLOAT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.DateType):
        return DATE
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return STRING


def sequence(item):
    return ("Seq", item)


def reference(classes) -> tuple:
    return ("Ref", frozenset(classes))


def is_sequence(ty) -> bool:
    return isinstance(ty, tuple) and ty[0] == "Seq"


def is_reference(ty) -> bool:
    return isinstance(ty, tuple) and ty[0] == "Ref"


def subtypes(a, b) -> bool:
    """May a value of type ``a`` stand where ``b`` is asked for? Null stands nowhere."""
    if UNKNOWN in (a, b) or a == b:
        return a != NULL
    if (a, b) == (INTEGER, FLOAT):
        return True
    if is_reference(a) and is_reference(b):
        return a[1] <= b[1]
    return is_sequence(a) and is_sequence(b) and subtypes(a[1], b[1])


def comparable(a, b) -> bool:
    return NULL in (a, b) or subtypes(a, b) or subtypes(b, a)


def spelled(ty) -> str:
    if is_sequence(ty):
        return f"Seq<{spelled(ty[1])}>"
    if is_reference(ty):
        return "Ref<" + " or ".join(sorted(i.replace("#", "/").rpartition("/")[2] for i in ty[1])) + ">"
    return ty


def spark_type(ty) -> T.DataType:
    if is_sequence(ty):
        return T.ArrayType(spark_type(ty[1]))
    return T.StringType() if is_reference(ty) else PRIMITIVES[ty][0]
