"""Per-column facts in one scan, distinct values and repeated rows by digest.

Wide aggregates keep a scan at one row per input row; unpivoting first would
multiply the rows by the column count. Metrics are SQL text, so a table of many
columns is planned from one list of strings instead of many small calls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.plans.digests import distinct_by_digest, repeated_rows
from tablegauge.plans.joins import one_row
from tablegauge.sources import schema as S

Metric = Callable[[str], str]


def text_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def wide(df: DataFrame, columns: Sequence[str], metrics: dict[str, Metric]) -> DataFrame:
    """One row: n_rows and `<i>_<metric>` for every column position i."""
    return df.selectExpr(
        "count(1) AS n_rows",
        *[f"{fn(c)} AS `{i}_{m}`" for i, c in enumerate(columns) for m, fn in metrics.items()],
    )


def tall(row: DataFrame, columns: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Turn the wide row into one row per column: ordinal, column, n_rows, metrics."""
    if not columns:
        nothing = [f"CAST(NULL AS DOUBLE) AS `{m}`" for m in metrics]
        return row.selectExpr("0 AS ordinal", "'' AS column", "n_rows", *nothing).filter(F.lit(False))
    structs = [
        f"named_struct('ordinal', {i}, 'column', {text_literal(c)}, 'n_rows', n_rows, "
        + ", ".join(f"'{m}', `{i}_{m}`" for m in metrics)
        + ")"
        for i, c in enumerate(columns)
    ]
    return row.selectExpr(f"inline(array({', '.join(structs)}))")


def per_column(df: DataFrame, columns: Sequence[str], metrics: dict[str, Metric]) -> DataFrame:
    """One scan, one output row per column."""
    return tall(wide(df, columns, metrics), columns, list(metrics))


def quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def known_sql(df: DataFrame, c: str) -> str:
    """The value with NaN as null."""
    if S.is_floating(df.schema[c].dataType):
        return f"CASE WHEN NOT isnan({quoted(c)}) THEN {quoted(c)} END"
    return quoted(c)


def number_sql(df: DataFrame, c: str) -> str:
    return f"CAST({known_sql(df, c)} AS DOUBLE)"


def null_count(df: DataFrame) -> Metric:
    return lambda c: f"count_if({known_sql(df, c)} IS NULL)"


def number(df: DataFrame, c: str) -> Column:
    """A numeric column as double with NaN as null."""
    return S.known(df, c).cast("double")


def column_facts(
    df: DataFrame, limit: float = 3.0, outliers: bool = True, temporal_as_string: bool = False, counts: bool = True
) -> DataFrame:
    """One row per comparable column: n_rows, nulls, lowest, variety, distinct, negatives, outliers.

    `variety` is 0 for an all-null column, 1 for a single value, 2 for more, which
    finds constant columns without counting distinct values. `distinct` is filled for
    text columns, unless `counts` is off. `outliers` counts values further than `limit` sample
    deviations from the mean, null without spread.

    Two scans without a row shuffle (fit as one row, then count outliers against it)
    and, if there is text, one for the least and greatest texts, and one that counts
    different texts by digest. Text minima stay out of the first aggregate: they would take
    it off the hash path. The fitted row is one scalar subquery used twice, so it is
    computed once.
    """
    names = [c for c in df.columns if S.kind(df.schema[c].dataType) != "other"]
    texts = [c for c in names if c in set(S.text_columns(df, temporal_as_string))]
    numeric = set(S.numeric_columns(df))
    none = "CAST(NULL AS DOUBLE)"

    def variety(c: str) -> str:
        v = known_sql(df, c)
        return "0" if c in texts else f"CASE WHEN count({v}) = 0 THEN 0 WHEN min({v}) = max({v}) THEN 1 ELSE 2 END"

    # only the metrics a column can have are aggregated; the others are constants
    fitted = numeric if outliers else set()
    metrics: dict[str, Metric] = {
        "nulls": null_count(df),
        "lowest": lambda c: "CAST(NULL AS STRING)" if c in texts else f"CAST(min({known_sql(df, c)}) AS STRING)",
        "variety": variety,
        "negatives": lambda c: f"count_if({number_sql(df, c)} < 0)" if c in numeric else "CAST(NULL AS BIGINT)",
        "mean": lambda c: f"avg({number_sql(df, c)})" if c in fitted else none,
        "sd": lambda c: f"stddev_samp({number_sql(df, c)})" if c in fitted else none,
    }
    row = wide(df, names, metrics)
    listed = [*metrics]
    if outliers:
        fit = one_row(row)
        counts = (df.withColumn("_fit", fit) if numeric else df).selectExpr(
            "count(1) AS _n",
            *[
                f"count_if(abs(({number_sql(df, c)} - _fit.`{i}_mean`) / nullif(_fit.`{i}_sd`, 0D)) > {limit}D) AS `{i}_outliers`"
                for i, c in enumerate(names)
                if c in numeric
            ],
        )
        row = counts.withColumn("_fit", fit).selectExpr(
            "_fit.*",
            *[
                f"`{i}_outliers`" if c in numeric else f"CAST(NULL AS BIGINT) AS `{i}_outliers`"
                for i, c in enumerate(names)
            ],
        )
        listed.append("outliers")
    facts = tall(row, names, listed)
    if not texts:
        return facts.withColumn("distinct", F.lit(None).cast("long"))
    text = lambda c: f"CAST({known_sql(df, c)} AS STRING)"
    ends = wide(df, texts, {
        "_lowest": lambda c: f"min({text(c)})",
        "_variety": lambda c: f"CASE WHEN min({text(c)}) IS NULL THEN 0 WHEN min({text(c)}) = max({text(c)}) THEN 1 ELSE 2 END",
    })
    # one row per text column
    told = tall(ends, texts, ["_lowest", "_variety"]).select("column", "_lowest", "_variety")
    if counts:
        told = told.join(F.broadcast(distinct_by_digest(df, texts)), "column", "left")
        distinct = F.when(F.col("_variety").isNotNull(), F.coalesce("distinct_values", F.lit(0)))
    else:
        told, distinct = told.withColumn("distinct_values", F.lit(None)), F.lit(None).cast("long")
    return facts.join(F.broadcast(told), "column", "left").withColumns({
        "distinct": distinct,
        "variety": F.coalesce("_variety", "variety"),
        "lowest": F.coalesce("_lowest", "lowest"),
    }).drop("_lowest", "_variety", "distinct_values")


def repeats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: n_rows and duplicate_rows, the rows that repeat an earlier one."""
    return repeated_rows(df, list(columns or df.columns))
