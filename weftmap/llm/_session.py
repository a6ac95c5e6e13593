"""Reading tables, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmap.session import cut, partitions

__all__ = ["cut", "integer_id", "partitions", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id column as a long. Ids are whole numbers in all operators of this package that compare them; others are refused."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"`{id_col}` holds {kind.simpleString()}, not whole numbers")
    return docs[id_col].cast("long")


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))
