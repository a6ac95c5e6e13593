"""Mixing sources to target weights, with DataFrame functions only.

Tokens are counted per source; each source gets a target, hence a repetition
rate (target over size). A document is emitted floor(rate) times, and once more
when a uniform number drawn from a hash of its id and the seed is below the
fraction that is left.

The work is two passes over the documents without a shuffle of texts: one
counts (partial sums meet by source), one emits. The table of rates has a row
per source; it is broadcast only after its rows have been counted and found to
be at most ``BROADCAST_SOURCES``, else it is joined by a shuffle that Spark may
split where a source is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmap.llm._session import cut, text_or_empty

WHITE = " \t\n\x0b\f\r"
MAX_RATE = 3
BROADCAST_SOURCES = 10_000
#: The uniform number is made of this many hexadecimal digits of a digest.
DIGITS = 12


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; 0 for null."""
    trimmed = F.rtrim(text_or_empty(text), F.lit(WHITE))
    return F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size) -> the same with weight, target and rate.

    Sources in code point order, null last, weigh 1, 2, .., ``cycle`` and again.
    They share the sum of all sizes by weight. No target is above ``max_rate``
    times its source's size: what is cut off is shared again by weight among the
    others. In order of size / weight the sources that are cut come first, and
    source i is cut when the level left by those before it, (sum of sizes - caps
    before) / (weights from i on), reaches its own cap / weight. All sums are
    integers; each target is one division and one product of doubles.

    The windows run over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * max_rate).cast("long"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    )
    weighed = weighed.withColumn("_wm_level", level)
    weighed = weighed.withColumn("_wm_cut", F.col("_wm_level") * F.col("weight") >= F.col("cap"))
    # the level of the first source that is not cut holds for all of those
    weighed = weighed.withColumn("_wm_final", F.min(F.when(~F.col("_wm_cut"), F.struct(by_rank(), F.col("_wm_level")))).over(whole))
    target = F.when(F.col("_wm_cut"), F.col("cap").cast("double")).otherwise(F.col("_wm_final._wm_level") * F.col("weight"))
    return weighed.withColumn("target", target).select(
        "source",
        "source_size",
        "weight",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def by_rank() -> Column:
    """What the sources are ordered by when caps are dealt out, as one comparable value."""
    return F.struct(
        (F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("no_source"), F.col("source").alias("name")
    ).alias("_wm_rank")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 digest of seed and id; a null id counts as the word null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_rate: int = MAX_RATE) -> DataFrame:
    """``docs`` with _wm_size, _wm_source_size, _wm_target and _wm_copies (how often each row is emitted).

    A null or empty text has size 0 and, like any row of a source without
    words, is emitted as its rate says: a source of size 0 has rate 0. Null is a
    source of its own, the last. Repeated rows draw the same number. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    own = docs.withColumn("_wm_size", word_count(docs[text_col])).withColumn("_wm_source", docs[source_col].cast("string"))
    sizes = own.groupBy(F.col("_wm_source").alias("source")).agg(F.sum("_wm_size").alias("source_size"))
    rates = cut(targets(sizes, max_rate=max_rate), "rates").select(
        F.col("source").alias("_wm_name"), F.col("source_size").alias("_wm_source_size"), F.col("target").alias("_wm_target"), F.col("rate").alias("_wm_rate")
    )
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = own.join(F.broadcast(rates) if small else rates, F.col("_wm_source").eqNullSafe(F.col("_wm_name")))
    whole = F.floor("_wm_rate")
    extra = (uniform(own[id_col], seed) < F.col("_wm_rate") - whole).cast("long")
    return joined.withColumn("_wm_copies", (whole + extra).cast("long")).drop("_wm_name", "_wm_source")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as :func:`plan_mix` says, with its columns."""
    planned = plan_mix(docs, **how).filter("_wm_copies > 0")
    return planned.withColumn("_wm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_wm_copies")))).select(*docs.columns)
