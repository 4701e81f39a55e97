"""Rows and cells by 128-bit digests, so that shuffles carry a few bytes for each, whatever its length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.sources import schema as S


def _plain(df: DataFrame, name: str) -> list[Column]:
    """What a digest reads of a cell: equal for cells that grouping takes as equal.

    Zeros have no sign. Elements of arrays and structs are read as JSON too, since hashing
    passes over nulls inside them; maps are read as JSON only.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if S.is_floating(kind):
        return [c + F.lit(0.0).cast(kind)]
    if kind.typeName() in ("array", "struct", "map"):
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return [text] if "map<" in kind.simpleString() else [text, c]
    return [c]


def digest(parts: Sequence[Column], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def row_digest(df: DataFrame, names: Sequence[str]) -> Callable[[int], Column]:
    """seed -> 64-bit digest of the named cells; which of them are null is part of it."""
    parts = [p for c in names for p in (F.col(f"`{c}`").isNull(), *_plain(df, c))]
    return lambda seed: digest(parts, seed)


def cell_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, a, b, n): each different known cell of each column, by digest, with its count."""
    cells = []
    for i, c in enumerate(names):
        parts = [F.lit(i), *_plain(df, c)]
        cells.append(F.when(S.known(df, c).isNotNull(), F.struct(
            F.lit(i).alias("at"), digest(parts, 1).alias("a"), digest(parts, 2).alias("b"))))
    found = df.select(F.inline(F.array(*cells))).where(F.col("at").isNotNull())
    counted = found.groupBy("at", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.array(*[F.lit(c) for c in names])[F.col("at")].alias("column"), "a", "b", "n")


def distinct_by_digest(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, distinct_values) for columns that have a known cell."""
    if not names:
        return df.sparkSession.createDataFrame([], "column string, distinct_values long")
    return cell_counts(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def repeated_rows(df: DataFrame, names: Sequence[str], digests: Callable[[int], Column] | None = None) -> DataFrame:
    """One row: n_rows and duplicate_rows, the rows that equal an earlier one, nulls equal.

    Rows are counted by a digest of 128 bits; a third digest tells whether a group's rows are one
    row. Only groups in which it differs, that is where different rows share a digest, are
    counted again by their cells.
    """
    of = digests or row_digest(df, names)
    cells = [F.col(f"`{c}`") for c in names]
    keyed = df.select(*cells, of(1).alias("_a"), of(2).alias("_b"), of(3).alias("_c"))
    groups = keyed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_c").alias("_low"), F.max("_c").alias("_high"))
    mixed = F.col("_low") != F.col("_high")
    sure = groups.where(~mixed).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"))
    doubtful = groups.where(mixed).select("_a", "_b")
    again = keyed.join(doubtful, ["_a", "_b"], "left_semi").groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    rest = again.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"))
    return sure.unionByName(rest).agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.sum("k")).alias("duplicate_rows"))
