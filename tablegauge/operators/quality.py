"""Data-quality checks. Each returns (check, column, severity, affected, pct, detail, fix)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.math import percent
from tablegauge.plans.digests import distinct_by_digest
from tablegauge.plans.facts import column_facts, null_count, number_sql, per_column, repeats, wide
from tablegauge.plans.sketches import distinct_states, merged_distinct
from tablegauge.sources import schema as S

ISSUE = ("check", "column", "severity", "affected", "pct", "detail", "fix")
NO_VERDICT = "none"
VERDICTS = {
    "critical": "critical: fix first",
    "high": "high: review first",
    "medium": "low or medium only: proceed with care",
    "low": "low or medium only: proceed with care",
}


def issue(check: str, severity: Column, affected: Column, pct: Column, detail: Column, fix: str, column: Column | None = None) -> Column:
    """One issue as a struct; `column` defaults to the row's column name."""
    return F.struct(
        F.lit(check).alias("check"),
        (F.col("column") if column is None else column).alias("column"),
        severity.alias("severity"),
        affected.cast("long").alias("affected"),
        pct.cast("double").alias("pct"),
        detail.alias("detail"),
        F.lit(fix).alias("fix"),
    )


def issues_where(facts: DataFrame, *tests: tuple[Column, Column]) -> DataFrame:
    """One row per (condition, issue) pair whose condition holds, over any facts table."""
    found = F.array_compact(F.array(*[F.when(test, made) for test, made in tests]))
    return facts.select(F.explode(found).alias("_i")).select("_i.*")


def _no_pct() -> Column:
    return F.lit(None).cast("double")


def _share(count: str) -> Column:
    return percent(F.col(count), F.col("n_rows"))


def missing_issue() -> tuple[Column, Column]:
    """The rounded percentage decides the severity."""
    pct = _share("nulls")
    severity = (
        F.when(pct > V.NULL_PCT_CRITICAL, "critical").when(pct > V.NULL_PCT_HIGH, "high").otherwise("medium")
    )
    detail = F.concat_ws(" ", F.col("nulls"), F.lit("of"), F.col("n_rows"), F.lit("cells missing"))
    return F.col("nulls") > 0, issue(
        "missing_values", severity, F.col("nulls"), pct, detail, "impute or drop_null_rows"
    )


def constant_issue(all_null: bool = True) -> tuple[Column, Column]:
    test = F.col("variety") <= 1 if all_null else F.col("variety") == 1
    detail = F.concat(F.lit("only value: "), F.coalesce("lowest", F.lit("(null)")))
    return test, issue("constant_column", F.lit("low"), F.col("n_rows"), _no_pct(), detail, "drop_constant_columns")


def cardinality_issue(check: str = "high_cardinality", limit: int = V.HIGH_CARDINALITY) -> tuple[Column, Column]:
    detail = F.concat_ws(" ", F.col("distinct"), F.lit("distinct values"))
    made = issue(check, F.lit("medium"), F.col("distinct"), _no_pct(), detail, "target_encode or hash_encode")
    return F.col("distinct") > limit, made


def negative_issue() -> tuple[Column, Column]:
    named = F.lit(False)
    for word in V.POSITIVE_NAME_WORDS:
        named = named | F.contains(F.lower("column"), F.lit(word))
    detail = F.concat_ws(" ", F.col("negatives"), F.lit("values below zero"))
    return named & (F.col("negatives") > 0), issue(
        "negative_values", F.lit("high"), F.col("negatives"), _share("negatives"), detail, "review source"
    )


def outlier_issue(check: str = "zscore_outliers") -> tuple[Column, Column]:
    detail = F.concat_ws(" ", F.col("outliers"), F.lit("values beyond the z limit"))
    return F.col("outliers") > 0, issue(
        check, F.lit("low"), F.col("outliers"), _share("outliers"), detail, "clip_iqr or log_transform"
    )


def check_missing(df: DataFrame) -> DataFrame:
    """Columns with missing cells, rated by their percentage."""
    facts = per_column(df, df.columns, {"nulls": null_count(df)})
    return issues_where(facts, missing_issue())


def check_duplicates(df: DataFrame, check: str = "duplicate_rows") -> DataFrame:
    """One issue if any row repeats an earlier one."""
    count = F.col("duplicate_rows")
    made = issue(
        check,
        F.lit("medium"),
        count,
        _share("duplicate_rows"),
        F.concat_ws(" ", count, F.lit("rows repeat an earlier row")),
        "drop_duplicate_rows",
        F.lit("ALL"),
    )
    return issues_where(repeats(df), (count > 0, made))


def check_constant(df: DataFrame, all_null: bool = True) -> DataFrame:
    """Columns with at most one distinct value; all_null=False leaves all-null columns out."""
    return issues_where(column_facts(df, outliers=False, counts=False), constant_issue(all_null))


def check_high_cardinality(
    df: DataFrame, limit: int = V.HIGH_CARDINALITY, temporal_as_string: bool = False, check: str = "high_cardinality",
    exact: bool = True,
) -> DataFrame:
    """String columns with more than `limit` distinct values; exact=False counts by sketch in one scan."""
    names = S.text_columns(df, temporal_as_string)
    counted = distinct_by_digest(df, names) if exact or not names else merged_distinct(distinct_states(df, names))
    return issues_where(counted.withColumnRenamed("distinct_values", "distinct"), cardinality_issue(check, limit))


def check_negative_in_positive(df: DataFrame) -> DataFrame:
    """Negative values in numeric columns whose name says they should be positive."""
    names = [c for c in S.numeric_columns(df) if any(w in c.lower() for w in V.POSITIVE_NAME_WORDS)]
    facts = per_column(df, names, {"negatives": lambda c: f"count_if({number_sql(df, c)} < 0)"})
    return issues_where(facts, negative_issue())


def check_zscore_outliers(df: DataFrame, limit: float = V.Z_LIMIT, check: str = "zscore_outliers") -> DataFrame:
    """Numeric columns with values further than `limit` sample deviations from the mean."""
    numbers = df.select(*S.numeric_columns(df))
    return issues_where(column_facts(numbers, limit), outlier_issue(check))


def severity_summary(issues: DataFrame) -> DataFrame:
    """(severity, issues)."""
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))


def overall_verdict(issues: DataFrame, when_clean: str = NO_VERDICT) -> DataFrame:
    """One row: total issues and the verdict of the worst severity present."""
    worst = F.max(severity_rank(F.col("severity")))
    verdict = None
    for place, severity in enumerate(V.SEVERITIES):
        test = F.col("_worst") == len(V.SEVERITIES) - place
        label = F.lit(VERDICTS[severity])
        verdict = F.when(test, label) if verdict is None else verdict.when(test, label)
    return issues.agg(F.count(F.lit(1)).alias("issues"), worst.alias("_worst")).select(
        "issues", verdict.otherwise(F.lit(when_clean)).alias("verdict")
    )


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for place, name in enumerate(V.SEVERITIES):
        out = F.when(severity == name, len(V.SEVERITIES) - place).otherwise(out)
    return out


def quality_report(df: DataFrame, temporal_as_string: bool = False) -> DataFrame:
    """All checks as one table.

    Every column check is read off one facts table: two scans without a row shuffle
    and one count of text values. Repeated rows need a shuffle of their own.
    """
    facts = column_facts(df, temporal_as_string=temporal_as_string)
    parts = [
        issues_where(
            facts, missing_issue(), constant_issue(), cardinality_issue(), negative_issue(), outlier_issue()
        ),
        check_duplicates(df),
    ]
    nested = [c for c in df.columns if S.kind(df.schema[c].dataType) == "other"]
    if nested:
        parts.append(check_missing(df.select(*nested)))
    return reduce(DataFrame.unionByName, parts)


def checked_size(df: DataFrame) -> DataFrame:
    """One row: rows_checked, columns_checked."""
    return wide(df, [], {}).select(
        F.col("n_rows").alias("rows_checked"), F.lit(len(df.columns)).cast("long").alias("columns_checked")
    )
