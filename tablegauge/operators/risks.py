"""Risks of training on a table. Issue rows have the same columns as the quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.math import percent, ratio
from tablegauge.functions.text import has_any
from tablegauge.operators import quality as Q
from tablegauge.plans.facts import column_facts, null_count, per_column
from tablegauge.plans.joins import join_fitted, one_row
from tablegauge.plans.quantiles import quantile_row
from tablegauge.session import keep
from tablegauge.sources import schema as S

# our own limit for the population stability index
PSI_LIMIT = 0.2
# share given to a bin that one period never fills, so the logarithm exists
EMPTY_SHARE = 1e-4
RISK_ORDER = (
    "missing_target", "null_target", "class_imbalance", "duplicate_records", "high_cardinality_column",
    "constant_column", "leakage_candidate", "outliers", "time_split",
)


def _none():
    return F.lit(None).cast("double")


def risk_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Critical if the target column is absent."""
    made = Q.issue(
        "missing_target", F.lit("critical"), F.col("n_rows"), _none(), F.lit("column is not in the table"), "add target", F.lit(target)
    )
    return Q.issues_where(df.agg(F.count(F.lit(1)).alias("n_rows")), (F.lit(target not in df.columns), made))


def null_target_issue():
    detail = F.concat_ws(" ", F.col("nulls"), F.lit("target values missing"))
    pct = percent(F.col("nulls"), F.col("n_rows"))
    return Q.issue("null_target", F.lit("critical"), F.col("nulls"), pct, detail, "drop_null_rows")


def risk_null_target(df: DataFrame, target: str) -> DataFrame:
    """Critical if the target has missing values."""
    facts = per_column(df, [target], {"nulls": null_count(df)})
    return Q.issues_where(facts, (F.col("nulls") > 0, null_target_issue()))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n, share) over the known target values."""
    counts = (
        df.select(S.known(df, target).alias("class"))
        .filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = df.agg(F.count(S.known(df, target))).scalar()
    return counts.withColumn("_total", total).select(
        "class", "n", ratio(F.col("n"), F.col("_total")).alias("share")
    )


def risk_class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """High if the rarest class holds less than a tenth. Text targets, or at most 20 classes."""
    text = S.kind(df.schema[target].dataType) == "string"
    rarest = class_distribution(df, target).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("k"), F.min("share").alias("share")
    )
    rare = (F.lit(text) | (F.col("classes") <= V.CLASS_LIMIT)) & (F.col("share") < V.MINORITY_SHARE)
    detail = F.concat_ws(" ", F.lit("rarest of"), F.col("classes"), F.lit("classes"))
    pct = F.round(F.col("share") * 100, 2)
    made = Q.issue("class_imbalance", F.lit("high"), F.col("k"), pct, detail, "balanced_class_weights", F.lit(target))
    return Q.issues_where(rarest, (rare, made))


def risk_duplicates(df: DataFrame) -> DataFrame:
    return Q.check_duplicates(df, "duplicate_records")


def risk_high_cardinality(df: DataFrame, temporal_as_string: bool = False) -> DataFrame:
    return Q.check_high_cardinality(df, temporal_as_string=temporal_as_string, check="high_cardinality_column")


def risk_constant(df: DataFrame) -> DataFrame:
    """Exactly one distinct value; all-null columns are not listed here."""
    return Q.check_constant(df, all_null=False)


def risk_outliers(df: DataFrame) -> DataFrame:
    return Q.check_zscore_outliers(df, check="outliers")


def leakage_names(columns: DataFrame, target: str | None = None) -> DataFrame:
    """Rows of a columns table whose name hints at knowledge from after the event."""
    name = F.lower("column")
    keep = has_any(name, V.LEAKAGE_NAME_WORDS)
    return columns.filter(keep & (name != F.lit(target.lower())) if target else keep)


def time_names(columns: DataFrame) -> DataFrame:
    """Rows of a columns table whose name hints at time."""
    return columns.filter(has_any(F.lower("column"), V.TIME_SPLIT_NAME_WORDS))


def _names(df: DataFrame) -> DataFrame:
    """Column names as rows next to the row count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("ordinal", "column")
    )


def risk_leakage_names(df: DataFrame, target: str | None = None) -> DataFrame:
    made = Q.issue("leakage_candidate", F.lit("high"), F.col("n_rows"), _none(), F.lit("may be known only afterwards"), "verify or drop")
    return Q.issues_where(leakage_names(_names(df), target), (F.lit(True), made))


def risk_time_split(df: DataFrame) -> DataFrame:
    """Medium if any column looks like time; lists them in table order."""
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column"))), lambda s: s["column"])
    listed = time_names(_names(df)).agg(
        F.count(F.lit(1)).alias("k"), F.array_join(in_order, ", ").alias("names")
    )
    made = Q.issue("time_split", F.lit("medium"), F.col("k"), _none(), F.col("names"), "temporal_split", F.lit("ALL"))
    return Q.issues_where(listed, (F.col("k") > 0, made))


def ml_risk_report(df: DataFrame, target: str | None = None, temporal_as_string: bool = False) -> DataFrame:
    """All risks as one table; `place` keeps the order of the checks.

    Null target, constants, text cardinality and outliers come from one facts table.
    """
    facts = column_facts(df, temporal_as_string=temporal_as_string)
    is_target = F.col("column") == F.lit(target)
    from_facts = Q.issues_where(
        facts,
        (is_target & (F.col("nulls") > 0), null_target_issue()),
        Q.constant_issue(all_null=False),
        Q.cardinality_issue("high_cardinality_column"),
        Q.outlier_issue("outliers"),
    )
    parts = [
        from_facts,
        risk_duplicates(df),
        risk_leakage_names(df, target),
        risk_time_split(df),
    ]
    if target:
        parts.append(
            risk_class_imbalance(df, target) if target in df.columns else risk_missing_target(df, target)
        )
    order = F.array(*[F.lit(c) for c in RISK_ORDER])
    together = reduce(DataFrame.unionByName, parts)
    return together.withColumn("place", F.array_position(order, F.col("check")) - 1)


def risk_verdict(issues: DataFrame) -> DataFrame:
    """Worst severity as text; there is no separate verdict for a clean table."""
    return Q.overall_verdict(issues, when_clean=Q.VERDICTS["low"])


def balanced_class_weights(df: DataFrame, target: str) -> DataFrame:
    """Add class_weight = rows / (classes x rows of the class)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    totals = one_row(counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")))
    weights = counts.withColumn("_t", totals).select(
        target, ratio(F.col("_t.n"), F.col("_t.k") * F.col("_n")).alias("class_weight")
    )
    return join_fitted(df, weights, [target], "left")


def schema_check(actual: DataFrame, expected: DataFrame, keys=("column",)) -> DataFrame:
    """(keys, dtype, expected_dtype, finding) for columns missing, extra or of another type."""
    want = expected.select(*keys, F.col("dtype").alias("expected_dtype"))
    joined = actual.select(*keys, "dtype").join(want, list(keys), "full")
    finding = (
        F.when(F.col("dtype").isNull(), "missing")
        .when(F.col("expected_dtype").isNull(), "extra")
        .when(F.col("dtype") != F.col("expected_dtype"), "changed")
    )
    return joined.withColumn("finding", finding).filter(F.col("finding").isNotNull())


def _bin_number(v, edges: list) -> Column:
    """How many of the sorted edges lie below v, by halving."""
    if not edges:
        return F.lit(0).cast("long")
    middle = len(edges) // 2
    above = _bin_number(v, edges[middle + 1 :]) + (middle + 1)
    return F.when(v > edges[middle], above).otherwise(_bin_number(v, edges[:middle]))


def drift_report(before: DataFrame, after: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: null-rate change, mean shift in deviations of `before`, PSI and a drift flag.

    Numeric columns are binned by the deciles of `before`, text columns by value (its digest).
    One pass over both tables counts bins and values and sums up their moments; it is written,
    one row per column and bin, and all figures come from it. The deciles are found before it,
    exact=False in one scan by a sketch.
    """
    names = columns or S.columns_of(before, "numeric", "string")
    numeric = [c for c in names if S.kind(before.schema[c].dataType) == "numeric"]
    probs = [i / 10 for i in range(1, 10)]
    both = before.select(*names, F.lit(0).alias("_after")).unionByName(after.select(*names, F.lit(1).alias("_after")))
    if numeric:
        wanted = {f"{i}_{k}": (c, p) for i, c in enumerate(names) if c in numeric for k, p in enumerate(probs)}
        both = both.withColumn("_edge", quantile_row(before, wanted, exact=exact))
    cells = []
    for i, c in enumerate(names):
        v = S.known(before, c)
        if c in numeric:
            x = v.cast("double")
            bin_no = F.when(x.isNotNull(), _bin_number(x, [F.col(f"_edge.`{i}_{k}`") for k in range(len(probs))]))
            label, other = bin_no, F.lit(0).cast("long")
        else:
            x = _none()
            label, other = (F.when(v.isNotNull(), F.xxhash64(F.lit(seed), v)) for seed in (1, 2))
        cells.append(F.struct(F.lit(i).alias("at"), label.alias("a"), other.alias("b"), x.alias("v")))
    was, now = F.col("_after") == 0, F.col("_after") == 1
    old, new = F.when(was, F.col("v")), F.when(now, F.col("v"))
    bins = keep(both.select("_after", F.inline(F.array(*cells))).groupBy("at", "a", "b").agg(
        F.count_if(was).alias("n0"), F.count_if(now).alias("n1"), F.avg(old).alias("mean0"), F.avg(new).alias("mean1"), F.var_pop(old).alias("var0")))

    filled = F.col("a").isNotNull()
    weighted = lambda n, mean: ratio(F.sum(F.when(filled, F.col(n) * F.col(mean))), F.sum(F.when(filled, F.col(n))))
    totals = bins.groupBy("at").agg(
        *[F.sum(F.when(filled, F.col(f"n{p}")).otherwise(0)).alias(f"known{p}") for p in (0, 1)],
        *[F.sum(f"n{p}").alias(f"rows{p}") for p in (0, 1)],
        weighted("n0", "mean0").alias("mean0"), weighted("n1", "mean1").alias("mean1"),
    )
    p = F.greatest(ratio(F.col("n0"), F.col("known0")), F.lit(EMPTY_SHARE))
    q = F.greatest(ratio(F.col("n1"), F.col("known1")), F.lit(EMPTY_SHARE))
    # squares within the bins and between them
    apart = F.col("n0") * (F.col("var0") + (F.col("mean0") - F.col("all0")) ** 2)
    # one row per column
    found = bins.where(filled).join(F.broadcast(totals.select("at", "known0", "known1", F.col("mean0").alias("all0"))), "at").groupBy("at").agg(
        F.sum((q - p) * F.ln(q / p)).alias("psi"), F.sum(F.when(F.col("n0") > 0, apart)).alias("squares"))
    nulls = lambda i: 1 - ratio(F.col(f"known{i}"), F.col(f"rows{i}"))
    sd = F.sqrt(ratio(F.col("squares"), F.when(F.col("known0") > 1, F.col("known0") - 1)))
    return totals.join(F.broadcast(found), "at", "left").select(
        F.array(*[F.lit(c) for c in names])[F.col("at")].alias("column"),
        nulls(0).alias("null_rate_before"),
        nulls(1).alias("null_rate_after"),
        (nulls(1) - nulls(0)).alias("null_rate_change"),
        ratio(F.col("mean1") - F.col("mean0"), sd).alias("mean_shift"),
        "psi",
        F.coalesce(F.col("psi") > PSI_LIMIT, F.lit(False)).alias("drift"),
    )
