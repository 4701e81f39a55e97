"""Mergeable sketches: distinct counts and quantiles of parts of a table, kept and merged.

A state is one sketch per part and column: a few kilobytes, whatever the part's size. States of
parts (days, files, loads) are stored once; the answer for all parts, or for some, merges them
and never reads the parts' rows again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.sources import schema as S

# 2^14 registers for a distinct count, 2,000 values for quantiles
LG_K = 14
K = 2000


def distinct_error(lg_k: int = LG_K) -> float:
    """Three standard errors of a merged distinct count, as a share of the count."""
    return 3 * 1.04 / math.sqrt(2**lg_k)


def rank_error(k: int = K) -> float:
    """How far a sketched quantile's rank may be off, as a share of the rows (99 % of the time)."""
    return 2.446 / k**0.9433


def _states(df: DataFrame, columns: Sequence[str], by: Sequence[str], sketch: Callable[[str], Column]) -> DataFrame:
    # one aggregate over all columns: rows are not multiplied, tasks send one row per part
    found = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*[sketch(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return found.select(*[F.col(f"`{c}`") for c in by], F.inline(cells))


def distinct_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """(by..., column, sketch) of the known values of each column. Values are compared as text."""
    # zeros have no sign
    value = lambda c: (S.known(df, c) + F.lit(0.0).cast(df.schema[c].dataType) if S.is_floating(df.schema[c].dataType) else S.known(df, c))
    return _states(df, columns, by, lambda c: F.hll_sketch_agg(value(c).cast("string"), lg_k))


def merged_distinct(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, distinct_values) of all states together, or of those of each group."""
    return states.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def quantile_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(by..., column, sketch) of the known numbers of each column."""
    return _states(df, columns, by, lambda c: F.kll_sketch_agg_double(S.known(df, c).cast("double"), k))


def merged_quantiles(states: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, prob, quantile) of all states together; null for a column without values."""
    merged = states.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch").alias("_all"))
    filled = F.coalesce(F.kll_sketch_get_n_double("_all"), F.lit(0)) > 0
    each = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.when(filled, F.kll_sketch_get_quantile_double("_all", F.lit(float(p)))).alias("quantile"))
        for p in probs
    ])
    return merged.select(*by, "column", F.inline(each))


def store_states(states: DataFrame, folder: str, part: str) -> None:
    """Write the states of one part to the folder; storing a part again replaces it."""
    (
        states.withColumn("part", F.lit(part)).repartition(1)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
    )


def stored_states(spark: SparkSession, folder: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The states of all parts of the folder, or of the named ones; `part` tells them apart."""
    found = spark.read.option("basePath", folder).schema("column string, sketch binary, part string").parquet(folder)
    return found if parts is None else found.where(F.col("part").isin(*parts))
