"""Profiles and data dictionaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.math import percent
from tablegauge.functions.text import first_match, has_any
from tablegauge.plans.digests import distinct_by_digest
from tablegauge.plans.facts import null_count, number, number_sql, per_column, repeats, text_literal, wide
from tablegauge.plans.joins import one_row
from tablegauge.plans.quantiles import quantile_row
from tablegauge.plans.sketches import distinct_states, merged_distinct
from tablegauge.sources import schema as S


def table_shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")
    )


def null_counts(df: DataFrame, all_columns: bool = False) -> DataFrame:
    """(column, nulls) for the columns that have any."""
    out = per_column(df, df.columns, {"nulls": null_count(df)}).select("column", "nulls")
    return out if all_columns else out.filter(F.col("nulls") > 0)


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: missing_cells and missing_percent of rows x columns, null for an empty table."""
    row = wide(df, df.columns, {"nulls": null_count(df)})
    cells = reduce(lambda a, b: a + b, [F.col(f"{i}_nulls") for i in range(len(df.columns))])
    return row.select(
        cells.alias("missing_cells"),
        percent(cells, F.col("n_rows") * len(df.columns)).alias("missing_percent"),
    )


def duplicate_row_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows that repeat an earlier row, nulls equal."""
    return repeats(df, columns).select("duplicate_rows")


def numeric_stats(df: DataFrame) -> DataFrame:
    """(column, min, max, mean, std, nulls) per numeric column; std is the sample form."""
    number = lambda c: number_sql(df, c)
    return per_column(
        df,
        S.numeric_columns(df),
        {
            "min": lambda c: f"min({number(c)})",
            "max": lambda c: f"max({number(c)})",
            "mean": lambda c: f"round(avg({number(c)}), 4)",
            "std": lambda c: f"round(stddev_samp({number(c)}), 4)",
            "nulls": null_count(df),
        },
    ).drop("ordinal", "n_rows")


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows by the given key."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).limit(n)


def profile_table(df: DataFrame) -> DataFrame:
    """(column, metric, value) with one scan for all column facts and one pass for repeats.

    Table-level metrics carry the column name "*".
    """
    numeric = set(S.numeric_columns(df))
    of_number = lambda text: (lambda c: text.format(number_sql(df, c)) if c in numeric else "CAST(NULL AS DOUBLE)")
    metrics = {
        "nulls": lambda c: f"CAST({null_count(df)(c)} AS DOUBLE)",
        "min": of_number("min({})"),
        "max": of_number("max({})"),
        "mean": of_number("round(avg({}), 4)"),
        "std": of_number("round(stddev_samp({}), 4)"),
    }
    row = wide(df, df.columns, metrics)
    cells = " + ".join(f"`{i}_nulls`" for i in range(len(df.columns)))
    named = [
        ("*", "rows", "CAST(n_rows AS DOUBLE)"),
        ("*", "columns", f"{len(df.columns)}D"),
        ("*", "missing_cells", f"({cells})"),
        ("*", "missing_percent", f"round(try_divide({cells}, CAST(n_rows AS DOUBLE) * {len(df.columns)}) * 100, 2)"),
    ] + [
        (c, m, f"`{i}_{m}`")
        for i, c in enumerate(df.columns)
        for m in metrics
        if m == "nulls" or c in numeric
    ]
    structs = [f"named_struct('column', {text_literal(c)}, 'metric', '{m}', 'value', {v})" for c, m, v in named]
    facts = row.selectExpr(f"inline(array({', '.join(structs)}))")
    copies = repeats(df).select(
        F.lit("*").alias("column"),
        F.lit("duplicate_rows").alias("metric"),
        F.col("duplicate_rows").cast("double").alias("value"),
    )
    return facts.filter((F.col("metric") != "nulls") | (F.col("value") > 0)).unionByName(copies)


# buckets of values for each sample wanted: a bucket keeps one number per task and column
SAMPLE_BUCKETS = 16


def _last_keys(df: DataFrame, names: Sequence[str], key: str, n: int) -> DataFrame:
    """One row with k0, k1, ...: a key up to which column i has n different values; null if it has fewer.

    Values are dealt into buckets and each bucket keeps the least key of its values, which tasks
    do on their own. n buckets that have begun by a key hold n values at least.
    """
    cells = [
        F.when(S.known(df, c).isNotNull(), F.struct(F.lit(i).alias("at"), F.pmod(F.xxhash64(f"`{c}`"), F.lit(SAMPLE_BUCKETS * n)).alias("bucket")))
        for i, c in enumerate(names)
    ]
    found = df.select(F.col(f"`{key}`").alias("_key"), F.inline(F.array(*cells))).where("at IS NOT NULL AND _key IS NOT NULL")
    begun = found.groupBy("at", "bucket").agg(F.min("_key").alias("_first"))
    nth = begun.groupBy("at").agg(F.get(F.sort_array(F.collect_list("_first")), F.lit(n - 1)).alias("_k"))
    return nth.agg(*[F.max(F.when(F.col("at") == i, F.col("_k"))).alias(f"k{i}") for i in range(len(names))])


def column_samples(df: DataFrame, order_by: str, n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, samples): the first n distinct non-missing values by `order_by`, as text.

    Values come by the least key that has them, then by their text; those without a key come
    last. Two scans: the first finds a key up to which each column has n values, the second
    groups the cells up to it, which are about n different ones, task by task.
    """
    names = [c for c in (columns or df.columns)]
    key = F.col(f"`{order_by}`")
    shaped = df.select(key.alias("_key"), *[F.col(f"`{c}`") for c in names if c != order_by], *([key] if order_by in names else []))
    fit = one_row(_last_keys(shaped, names, "_key", n))
    near = lambda i: F.col(f"_fit.k{i}").isNull() | (F.col("_key") <= F.col(f"_fit.k{i}"))
    cells = [
        F.when(S.known(df, c).isNotNull() & near(i), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")))
        for i, c in enumerate(names)
    ]
    found = shaped.withColumn("_fit", fit).select("_key", F.inline(F.array(*cells))).where("column IS NOT NULL")
    seen = found.groupBy("column", "value").agg(F.min("_key").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.asc_nulls_last("_first"), "value"))
    return (
        seen.withColumn("_rank", rank)
        .filter(F.col("_rank") <= n)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "value"))).alias("_s"))
        .select("column", F.col("_s.value").alias("samples"))
    )


def _counted(df: DataFrame, names: Sequence[str], counted: DataFrame) -> DataFrame:
    """One row for each name, which the schema knows, with its count or 0."""
    named = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return named.join(F.broadcast(counted), "column", "left").select(
        "column", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values")
    )


def _countable(df: DataFrame) -> list[str]:
    return [c for c in df.columns if S.kind(df.schema[c].dataType) != "other"]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, distinct_values), nulls not counted.

    Exact counts shuffle one digest for each different cell of a task; exact=False uses a sketch
    for each column in one scan. Sketches of parts of a table that are kept and merged are in
    `plans/sketches.py`.
    """
    names = list(columns or _countable(df))
    found = distinct_by_digest(df, names) if exact else merged_distinct(distinct_states(df, names))
    return _counted(df, names, found)


def column_meaning(columns: DataFrame) -> DataFrame:
    """Add `meaning` to a columns table: the first matching name rule."""
    return columns.withColumn("meaning", first_match(F.lower("column"), V.MEANING_RULES, "unclear"))


def column_role_flags(columns: DataFrame) -> DataFrame:
    """Add is_likely_id, is_likely_date and is_likely_categorical.

    Needs columns `kind`, `integral` or `dtype`, `nulls` and `distinct_values`. An integer
    column with nulls counts as floating, as it would when read from an untyped file.
    """
    name = F.lower("column")
    is_id = has_any(name, dict(V.MEANING_RULES)["identifier"])
    few = F.col("distinct_values") < V.CATEGORICAL_DISTINCT
    whole = F.col("dtype").isin("tinyint", "smallint", "int", "bigint", "boolean")
    categorical = F.col("kind").isin("string", "temporal") | (few & whole & (F.col("nulls") == 0))
    return columns.select(
        "*",
        is_id.alias("is_likely_id"),
        has_any(name, V.DATE_FLAG_WORDS).alias("is_likely_date"),
        (categorical & ~is_id).alias("is_likely_categorical"),
    )


def column_facts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Columns table of one DataFrame with nulls and distinct_values."""
    meta = S.columns_table(df.sparkSession, {"data": df}).drop("dataset")
    nulls = null_counts(df, all_columns=True)
    # all three sides have one row per column
    return meta.join(F.broadcast(nulls), "column").join(F.broadcast(distinct_counts(df, exact=exact)), "column", "left")


def data_dictionary(df: DataFrame, order_by: str, exact: bool = True) -> DataFrame:
    """One row per column: type, meaning, samples, nulls, distinct values, role flags."""
    described = column_role_flags(column_meaning(column_facts(df, exact)))
    return described.join(F.broadcast(column_samples(df, order_by)), "column", "left")


def column_summary(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """One row for a numeric column: mean, median, std, min, max, count of known values.

    exact=False takes the median from a sketch, in the scan's own size (`plans/quantiles.py`).
    """
    S.require_numeric(df, column)
    v = number(df, column)
    return df.agg(
        F.round(F.avg(v), 4).alias("mean"),
        F.round(F.stddev_samp(v), 4).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(v).alias("count"),
    ).withColumn("median", F.round(quantile_row(df, {"q": (column, 0.5)}, exact=exact).getField("q"), 4))
