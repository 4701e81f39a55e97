"""Train and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.math import micros
from tablegauge.plans.joins import join_null_safe
from tablegauge.plans.ordered import running_totals
from tablegauge.plans.quantiles import quantile_row

HOUR = 3_600_000_000


def _by_hour(v: Column) -> Column:
    return F.floor(v / HOUR)


def time_cuts(df: DataFrame, ts: str, probs: list[float], exact: bool = True):
    """Event times (in microseconds) at the given shares of rows, as one struct column."""
    timed = df.select(micros(F.col(ts)).alias("_t"))
    return quantile_row(
        timed, {f"c{i}": ("_t", p) for i, p in enumerate(probs)}, interpolate=False, bin_of=_by_hour, exact=exact
    )


def temporal_split(df: DataFrame, ts: str, train_share: float = 0.8, cutoff: Column | None = None, exact: bool = True) -> DataFrame:
    """Add `split`: train up to the cutoff time, test after it. Equal times stay together.

    exact=False finds the cutoff by a sketch; the train share is then near the one asked for.
    """
    if cutoff is not None:
        return df.withColumn("split", F.when(F.col(ts) <= cutoff, "train").otherwise("test"))
    cut = time_cuts(df, ts, [train_share], exact).getField("c0")
    return (
        df.withColumn("_cut", cut)
        .withColumn("split", F.when(micros(F.col(ts)) <= F.col("_cut"), "train").otherwise("test"))
        .drop("_cut")
    )


def stratified_split(df: DataFrame, target: str, key: str, train_share: float = 0.8) -> DataFrame:
    """Add `split` with floor(share x rows) of every class in train, chosen by a digest of the key.

    Rows are numbered within (class, digest prefix), so one large class is spread out.
    """
    digest = df.withColumns({"_d": F.md5(F.col(key).cast("string")), "_one": F.lit(1).cast("long")})
    ranked = running_totals(digest, [target], [F.substring("_d", 1, 4)], [F.col("_d"), F.col(key)], ["_one"])
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_null_safe(ranked, sizes, [target])
    inside = F.col("_one_upto") <= F.floor(F.round(F.col("_n") * F.lit(train_share), 6))
    return joined.select(*df.columns, F.when(inside, "train").otherwise("test").alias("split"))


def random_split(df: DataFrame, key: str, train_percent: int = 80) -> DataFrame:
    """Add `split` by a digest of the key: the same key always lands on the same side."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(F.pmod(digest, F.lit(100)) < train_percent, "train").otherwise("test"))


def time_series_folds(df: DataFrame, ts: str, folds: int = 3) -> DataFrame:
    """Rows repeated per expanding-window fold with columns `fold` and `role`.

    The time axis is cut into folds + 1 parts of equal row share; fold i trains on
    the first i parts and tests on the next one.
    """
    parts = folds + 1
    cuts = time_cuts(df, ts, [i / parts for i in range(1, parts)])
    timed = df.withColumns({"_cuts": cuts, "_t": micros(F.col(ts))})
    part = sum(
        [(F.col("_t") > F.col(f"_cuts.c{i}")).cast("int") for i in range(parts - 1)], F.lit(0)
    )
    rows = timed.withColumn("_part", part).withColumn(
        "fold", F.explode(F.sequence(F.greatest(F.col("_part"), F.lit(1)), F.lit(folds)))
    )
    return rows.withColumn("role", F.when(F.col("_part") < F.col("fold"), "train").otherwise("test")).drop(
        "_cuts", "_t", "_part"
    )
