"""Text and table helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablegauge.session import keep, new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# separators between words: ASCII white space
SPACE = r"[\x20\x09-\x0D]+"
# separators between alphanumeric words: every ASCII character but digits and lower-case letters
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# a table may be sent to every executor up to this many bytes, as measured
BROADCAST_BYTES = 32 << 20
# parts in which the driver gets a table that it puts together
FETCHES = 8


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def split_words(c: Column, separators: str = SPACE) -> Column:
    """The non-empty pieces between runs of separators."""
    return F.array_remove(F.split(c, separators), "")


def neighbours(array: Column, distance: int, combine) -> Column:
    """combine(x[i], x[i + distance]) for every i that has both; empty if none has."""
    n = F.greatest(F.size(array) - distance, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(1 + distance), n), combine)


def sliding(df: DataFrame, source: str, name: str, width: int, combine) -> DataFrame:
    """Add `name`: combine over every run of `width` neighbours of the array `source`.

    Doubles the width from step to step, so it takes about log2(width) passes; the last step
    overlaps, which fits minima and hashes that only serve as identities.
    """
    at, df = 1, df.withColumn(name, F.col(source))
    while at < width:
        by = min(at, width - at)
        df = df.withColumn(name, neighbours(F.col(name), by, combine))
        at += by
    return df


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on equally named keys where null equals null; keeps the left copy of the keys."""
    other = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), computed once.

    Spark moves a plain filter below the projections that lead to it and copies their
    expressions into it, several times over if columns build on each other. What a generator
    gives is filtered where it is.
    """
    return df.withColumn("_met", F.explode_outer(F.array(condition))).where("_met").drop("_met")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fetched(df: DataFrame, label: str) -> Iterator[Row]:
    """The rows of a table, some at a time; its tasks run at once, and the driver runs FETCHES jobs, not one for each task."""
    return written(df, label).coalesce(FETCHES).toLocalIterator()


__all__ = [
    "BROADCAST_BYTES", "FETCHES", "NOT_WORD", "SPACE", "UPPER", "fetched", "keep", "lower_ascii", "neighbours", "null_safe",
    "sliding", "split_words", "where_computed", "whole", "written",
]
